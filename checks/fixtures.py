"""Stand-ins for transcript tables, derived from the given tables on both engines.

Each view exists as a Spark DataFrame function and as SQL text with the same content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearken.functions import normalize_full
from hearken.functions.text import WHITESPACE_CLASS as WS, WORD_CLASS

SYSTEMS = ["a", "b", "c"]
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абцдефгхийклмнопярстуввхыз"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, as it is read."""
    return table(spark, sf_dir, name)


def utt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with their truth: every turn of every conversation."""
    turns = texts(spark, sf_dir, "conversations")
    name = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return turns.select(
        name.alias("utt_id"),
        F.concat(F.lit("rec/"), "role", F.lit("/"), name, F.lit(".wav")).alias("path"),
        "text",
        normalize_full("text").alias("ref"),
        "role",
        "conv_id",
        "turn",
        F.translate(F.lower("text"), LATIN, CYRILLIC).alias("cyr"),
    )


def hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of three systems: the truth with fixed word edits, `(utt_id, system, hyp)`."""
    words = F.split("ref", " ")
    n = lambda i: i + 1
    a = F.transform(
        F.filter(words, lambda x, i: n(i) % 7 != 0),
        lambda x, i: F.when(n(i) % 5 == 0, F.concat(x, F.lit("x"))).otherwise(x),
    )
    b = F.transform(
        words,
        lambda x, i: F.when(n(i) % 6 == 0, F.concat(x, F.lit(" zz")))
        .when(n(i) % 4 == 0, F.concat(x, F.lit("y")))
        .otherwise(x),
    )
    c = F.filter(words, lambda x, i: n(i) % 9 != 0)
    spoken = F.array(
        *[
            F.struct(F.lit(s).alias("system"), F.array_join(w, " ").alias("hyp"))
            for s, w in zip(SYSTEMS, [a, b, c])
        ]
    )
    said = utt(spark, sf_dir).where(F.col("ref") != "")
    return said.select("utt_id", F.inline(spoken))


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a test flag where one is known."""
    return (
        texts(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select("doc_id", "text", F.col("quality").alias("test"))
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip path per document."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("rec/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return docs.select("doc_id", path.alias("path"), "source")


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the clips that exist: those of labelled documents."""
    path = F.concat(F.lit("rec/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return table(spark, sf_dir, "labels").select(path.alias("path"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors as frames, ten to an utterance."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("utt_id"),
        (F.col("vec_id") % 10).alias("frame_no"),
        "embedding",
    )


# ---- the same views as SQL text -------------------------------------------------------


def sql_norm(column: str) -> str:
    deleted = f"regexp_replace(lower(coalesce({column},'')),'[^{WORD_CLASS}{WS}]','','g')"
    return f"trim(regexp_replace({deleted},'[{WS}]+',' ','g'))"


SQL_UTT = f"""utt as (
  select concat(conv_id,'-',turn) as utt_id,
         concat('rec/',role,'/',conv_id,'-',turn,'.wav') as path,
         text, {sql_norm('text')} as ref, role, conv_id, turn,
         translate(lower(text),'{LATIN}','{CYRILLIC}') as cyr
  from conversations)"""

SQL_HYP = """spoken as (select utt_id, string_split(ref,' ') r from utt where ref <> ''),
hyp as (
  select utt_id, 'a' as system, array_to_string(list_transform(
    list_filter(r, lambda x,i: i%7<>0),
    lambda x,i: case when i%5=0 then x||'x' else x end),' ') as hyp from spoken
  union all
  select utt_id, 'b', array_to_string(list_transform(r,
    lambda x,i: case when i%6=0 then x||' zz' when i%4=0 then x||'y' else x end),' ') from spoken
  union all
  select utt_id, 'c', array_to_string(list_filter(r, lambda x,i: i%9<>0),' ') from spoken)"""

SQL_LAB = """lab as (
  select d.doc_id, d.text, l.quality as test
  from documents d left join labels l on d.doc_id = l.doc_id)"""

SQL_CLIPS = """clips as (select doc_id, concat('rec/',doc_id,'.wav') as path, source from documents),
present as (select concat('rec/',doc_id,'.wav') as path from labels)"""

SQL_WIDE = """wide as (
  select u.utt_id, u.ref, max(hyp) filter (system='a') as a,
         max(hyp) filter (system='b') as b, max(hyp) filter (system='c') as c
  from hyp h join utt u on h.utt_id = u.utt_id group by u.utt_id, u.ref)"""


def sql_words(column: str) -> str:
    """Words of a text whose words are separated by single spaces."""
    return f"list_filter(string_split({column},' '), lambda w: w <> '')"


def sql_raw_words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column},'[{WS}]+'), lambda w: w <> '')"


# Levenshtein distance of word lists r and h, row by row
SQL_EDITS = """list_extract(list_reduce(h, lambda p,w:
  list_reduce(range(1,len(r)+1), lambda q,i:
    list_append(q, least(p[i] + case when r[i]=w then 0 else 1 end, p[i+1]+1, q[len(q)]+1)),
    [p[1]+1]),
  range(0,len(r)+1)), -1)"""


def sql_scripts(pairs: str) -> str:
    """CTEs ending in `scripts(k, r, h, script)` for a CTE `pairs(k, r, h)` of word lists.

    Costs to go are built from the last word back, one row per hypothesis word; then the
    first of A, D, I that keeps the cost is taken until both texts are used up.
    """
    return f"""pair as materialized (
  select k, r, h, list_reverse(r) rr, list_reverse(h) hr from {pairs}),
going(k, n, p) as (
  select k, 0, range(0,len(r)+1) from pair
  union all
  select k, n+1, list_reduce(range(1,len(rr)+1), lambda q,i:
      list_append(q, least(p[i] + case when rr[i]=w then 0 else 1 end, p[i+1]+1, q[-1]+1)),
      [p[1]+1])
  from (select g.k, g.n, g.p, x.rr, x.hr[g.n+1] w
        from going g join pair x on g.k = x.k and g.n < len(x.hr))),
togo as (select k, list(p order by n) m from going group by k),
scripts as (
  select k, r, h, list_reduce(range(0,len(r)+len(h)), lambda s,step:
    case when s.i > len(r) and s.j > len(h) then s
      when s.i <= len(r) and s.j <= len(h)
        and m[len(h)-s.j+1][len(r)-s.i+1] + case when r[s.i]=h[s.j] then 0 else 1 end
          = m[len(h)-s.j+2][len(r)-s.i+2]
        then {{'i': s.i+1, 'j': s.j+1, 's': s.s||'A'}}
      when s.i <= len(r)
        and m[len(h)-s.j+2][len(r)-s.i+1] + 1 = m[len(h)-s.j+2][len(r)-s.i+2]
        then {{'i': s.i+1, 'j': s.j, 's': s.s||'D'}}
      else {{'i': s.i, 'j': s.j+1, 's': s.s||'I'}} end,
    {{'i': 1::bigint, 'j': 1::bigint, 's': ''}}).s as script
  from pair join togo using (k))"""


def sql_split(source: str, key: str, seed: int = 42) -> str:
    """`split` by the rank of a seeded hash."""
    return f"""select *, case when row_number() over (order by md5('{seed}:'||{key}), {key})
      <= ceil(count(*) over () * 0.1::double) then 'test' else 'train' end as split from {source}"""

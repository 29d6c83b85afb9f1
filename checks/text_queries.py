"""Text functions, segments, alphabets, labels, batches, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    SQL_UTT,
    WS,
    frames,
    sql_norm,
    sql_split,
    table,
    texts,
    utt,
)
from hearken.functions import (
    argmax,
    encode_chars,
    normalize_cyrillic,
    normalize_full,
    normalize_punct,
    split_words,
    strip,
    strip_lower,
    unmask_decode,
)
from hearken.functions.labels import split_chars
from hearken.operators import (
    alphabet,
    collect_vocab,
    ctc_greedy_decode,
    ctc_vocab,
    distinct_chars,
    exact_split,
    join_segments,
    length_batches,
    lookup_ids,
    pad_batch,
)

# the frames' four labels: a blank, two letters and the word mark
FRAME_VOCAB = {"_": 0, "a": 1, "|": 2, "b": 3}


def norm_docs(spark, d):
    return texts(spark, d, "documents").select(
        "doc_id", "lang", normalize_full("text").alias("text")
    )


def doc_vocab(spark, d):
    return collect_vocab(ctc_vocab(norm_docs(spark, d)))


def joined(ids):
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def full(spark, d):
    return norm_docs(spark, d).select("doc_id", "text")


def cyrillic(spark, d):
    return utt(spark, d).select("utt_id", normalize_cyrillic("cyr").alias("text"))


def punct(spark, d):
    docs = texts(spark, d, "documents")
    return docs.select("doc_id", normalize_punct("text").alias("text"))


def stripped(spark, d):
    padded = F.concat(F.lit(" \t "), "text", F.lit("  \n"))
    return texts(spark, d, "documents").select(
        "doc_id", strip(padded).alias("kept_case"), strip_lower(padded).alias("lowered")
    )


def words(spark, d):
    docs = texts(spark, d, "documents")
    return docs.select("doc_id", split_words("text").alias("w")).select(
        "doc_id",
        F.size("w").alias("n_words"),
        F.md5(F.array_join("w", "\n")).alias("words"),
    )


def encoded(spark, d):
    vocab = collect_vocab(ctc_vocab(exact_split(norm_docs(spark, d), "doc_id").where("split = 'train'")))
    labelled = norm_docs(spark, d).withColumn("ids", encode_chars("text", vocab))
    return labelled.select(
        "doc_id", F.size("ids").alias("n_labels"), F.md5(joined("ids")).alias("labels")
    )


def looked_up(spark, d):
    """How often each label occurs: characters are counted first, then looked up."""
    vocab = collect_vocab(ctc_vocab(utt(spark, d).where("role = 'user'"), "ref"))
    chars = utt(spark, d).select(F.explode(split_chars("ref")).alias("ch"))
    return lookup_ids(chars.groupBy("ch").agg(F.count("*").alias("n")), vocab)


def decoded(spark, d):
    vocab = doc_vocab(spark, d)
    batched = length_batches(norm_docs(spark, d), "doc_id", F.length("text"))
    labels = pad_batch(
        batched.withColumn("ids", encode_chars("text", vocab)), ["megabatch", "batch"], "ids"
    )
    return labels.select("doc_id", unmask_decode("labels", vocab).alias("text"))


def best_index(spark, d):
    return table(spark, d, "embeddings").select("vec_id", argmax("embedding").alias("best"))


def alphabet_all(spark, d):
    return alphabet(texts(spark, d, "documents"), "text")


def alphabet_train(spark, d):
    train = exact_split(texts(spark, d, "documents"), "doc_id").where("split = 'train'")
    return alphabet(train.select(normalize_full("text").alias("text")))


def chars(spark, d):
    return distinct_chars(texts(spark, d, "documents"), "text")


def vocab_train(spark, d):
    return ctc_vocab(exact_split(norm_docs(spark, d), "doc_id").where("split = 'train'"))


def segments(spark, d):
    return join_segments(table(spark, d, "conversations"), "conv_id", "turn")


def split_sizes(spark, d):
    return exact_split(table(spark, d, "documents").select("doc_id"), "doc_id")


def batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return length_batches(docs, "doc_id", "n_chars")


def _padded(spark, d, batch_size, start):
    vocab = doc_vocab(spark, d)
    batched = length_batches(norm_docs(spark, d), "doc_id", F.length("text"), batch_size)
    ids = encode_chars("text", vocab)
    if start:
        # English rows begin with a start id
        first = F.when(F.col("lang") == "en", F.array(F.lit(start)))
        ids = F.concat(F.coalesce(first, F.array().cast("array<int>")), ids)
    labels = pad_batch(
        batched.withColumn("ids", ids), ["megabatch", "batch"], "ids", start or None
    )
    return labels.select(
        "doc_id",
        "megabatch",
        "batch",
        F.size("labels").alias("width"),
        F.md5(joined(F.col("labels"))).alias("labels"),
    )


def padded(spark, d):
    return _padded(spark, d, 16, None)


def padded_start(spark, d):
    return _padded(spark, d, 2, 9000)


def ctc_text(spark, d):
    token = argmax("embedding") % 4
    return ctc_greedy_decode(frames(spark, d), FRAME_VOCAB, 0, token, frames_per_run=4)


SQL_NORM_DOCS = f"docs as (select doc_id, lang, {sql_norm('text')} as text from documents)"
SQL_TRAIN_DOCS = (
    f"{SQL_NORM_DOCS}, parts as ({sql_split('docs', 'doc_id')}), "
    "train as (select text from parts where split = 'train')"
)


def sql_vocab(source: str, text: str = "text") -> str:
    """CTE `vocab(ch, id)`, and `letters(l)`: its characters as one ordered list."""
    return f"""chars as (select distinct unnest(string_split({text},'')) ch from {source} where {text} <> ''),
    vocab as (
      select case when ch=' ' then '|' else ch end as ch,
             (row_number() over (order by ch) - 1)::int as id from chars
      union all select '[UNK]', count(*)::int from chars
      union all select '[PAD]', count(*)::int + 1 from chars),
    letters as (select list(ch order by ch) l from chars)"""


SQL_IDS = "list_transform(list_filter(string_split(text,''), c -> c <> ''), lambda c: coalesce(list_position(l, c) - 1, len(l)))".replace(
    "c -> c <> ''", "lambda c: c <> ''"
)


def sql_batches(source: str, length: str, size: int) -> str:
    return f"""grouped as (
      select *, ('0x' || left(md5(doc_id::varchar),8))::bigint
        % greatest(1, ceil((select count(*) from {source}) / {size * 50}.0))::bigint as megabatch
      from {source}),
    batched as (
      select *, ((row_number() over (partition by megabatch order by {length} desc, doc_id) - 1)
        // {size})::int as batch from grouped)"""


def sql_padded(size: int, start: int | None) -> str:
    ids = SQL_IDS
    if start:
        ids = f"list_concat(case when lang = 'en' then [{start}] else [] end, {SQL_IDS})"
    begins = f"coalesce(ids[1] = {start}, false)" if start else "false"
    return f"""with {SQL_NORM_DOCS}, {sql_vocab('docs')}, {sql_batches('docs', 'length(text)', size)},
    labelled as (select doc_id, megabatch, batch, {ids} as ids from batched, letters),
    widths as (
      select *, max(len(ids)) over (partition by megabatch, batch) as longest,
        bool_and({begins}) over (partition by megabatch, batch) as drop_first from labelled),
    filled as (
      select doc_id, megabatch, batch,
        list_resize(case when drop_first then ids[2:] else ids end,
          longest - drop_first::int, -100) as labels from widths)
    select doc_id, megabatch, batch, len(labels)::int as width,
      md5(array_to_string(labels, ',')) as labels from filled"""


QUERIES = {
    "normalize_full": (full, f"select doc_id, {sql_norm('text')} as text from documents"),
    "normalize_cyrillic": (
        cyrillic,
        f"""with {SQL_UTT} select utt_id,
        lower(regexp_replace(cyr,'[^\\x{{0400}}-\\x{{04FF}}{WS}]','','g')) as text from utt""",
    ),
    "normalize_punct": (
        punct,
        """select doc_id, lower(translate(text, ',?!.-;:"«»', '')) as text from documents""",
    ),
    "strip": (
        stripped,
        f"""select doc_id, regexp_replace(text,'^[{WS}]+|[{WS}]+$','','g') as kept_case,
        lower(regexp_replace(text,'^[{WS}]+|[{WS}]+$','','g')) as lowered from documents""",
    ),
    "split_words": (
        words,
        f"""with w as (select doc_id, list_filter(regexp_split_to_array(text,'[{WS}]+'),
          lambda x: x <> '') as w from documents)
        select doc_id, len(w)::int as n_words, md5(array_to_string(w, chr(10))) as words from w""",
    ),
    "encode_chars": (
        encoded,
        f"""with {SQL_TRAIN_DOCS}, {sql_vocab('train')},
        labelled as (select doc_id, {SQL_IDS} as ids from docs, letters)
        select doc_id, len(ids)::int as n_labels, md5(array_to_string(ids, ',')) as labels
        from labelled""",
    ),
    "lookup_ids": (
        looked_up,
        f"""with {SQL_UTT}, said as (select ref as text from utt where role = 'user'),
        {sql_vocab('said')},
        seen as (select unnest(string_split(ref,'')) ch from utt where ref <> '')
        select ch, count(*) as n, coalesce(list_position(l, ch) - 1, len(l))::int as id
        from seen, letters group by ch, l""",
    ),
    "unmask_decode": (decoded, f"with {SQL_NORM_DOCS} select doc_id, text from docs"),
    "argmax": (
        best_index,
        """select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as best
        from embeddings""",
    ),
    "alphabet_all_rows": (
        alphabet_all,
        """with c as (select distinct unnest(string_split(text,'')) ch from documents
          where text <> '')
        select (row_number() over (order by ch) - 1)::int as pos, ch from c""",
    ),
    "alphabet_train_rows": (
        alphabet_train,
        f"""with {SQL_TRAIN_DOCS},
        c as (select distinct unnest(string_split(text,'')) ch from train where text <> '')
        select (row_number() over (order by ch) - 1)::int as pos, ch from c""",
    ),
    "distinct_chars": (
        chars,
        "select distinct unnest(string_split(text,'')) as ch from documents where text <> ''",
    ),
    "ctc_vocab": (
        vocab_train,
        f"with {SQL_TRAIN_DOCS}, {sql_vocab('train')} select ch, id from vocab",
    ),
    "join_segments": (
        segments,
        f"""select conv_id, regexp_replace(string_agg(text, '' order by turn),
        '^[{WS}]+|[{WS}]+$','','g') as text from conversations group by conv_id""",
    ),
    "exact_split": (
        split_sizes,
        sql_split("(select doc_id from documents)", "doc_id"),
    ),
    "length_batches": (
        batches,
        f"""with docs as (select doc_id, n_chars from documents),
        {sql_batches('docs', 'n_chars', 16)}
        select doc_id, n_chars, megabatch, batch from batched""",
    ),
    "pad_batch": (padded, sql_padded(16, None)),
    "pad_batch_start_id": (padded_start, sql_padded(2, 9000)),
    "ctc_greedy_decode": (
        ctc_text,
        """with f as (
          select vec_id // 10 as utt_id, vec_id % 10 as frame_no,
            (list_position(embedding, list_max(embedding)) - 1) % 4 as id from embeddings),
        runs as (
          select *, lag(id) over (partition by utt_id order by frame_no) as before from f),
        kept as (
          select utt_id, string_agg(['a','|','b'][id], '' order by frame_no) as text
          from runs where id <> 0 and id is distinct from before group by utt_id)
        select utt_id, trim(replace(coalesce(text, ''), '|', ' ')) as text
        from (select distinct utt_id from f) left join kept using (utt_id)""",
    ),
}

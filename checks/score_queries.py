"""Alignment, voting, error rates, model selection, user scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    SQL_EDITS,
    SQL_HYP,
    SQL_UTT,
    SQL_WIDE,
    SYSTEMS,
    hyp,
    sql_raw_words,
    sql_scripts,
    sql_words,
    table,
    utt,
)
from hearken.functions import align_words, normalize_full, percent
from hearken.operators import (
    assemble_hypotheses,
    attach_outputs,
    best_run,
    corpus_wer,
    latency_compare,
    latest_checkpoint,
    rover,
    score_batches,
    utterance_edits,
    wer_by_system,
    wer_of_columns,
)


def wide(spark, d):
    refs = utt(spark, d).select("utt_id", "ref")
    return assemble_hypotheses(refs, hyp(spark, d), SYSTEMS)


def edits(spark, d):
    return utterance_edits(hyp(spark, d), utt(spark, d))


def scripts(spark, d):
    heard = attach_outputs(hyp(spark, d), utt(spark, d).select("utt_id", "ref"))
    return heard.select("utt_id", "system", align_words("ref", "hyp").alias("script"))


def detail(spark, d):
    return utterance_edits(hyp(spark, d), utt(spark, d), detail=True)


def pooled(spark, d):
    heard = attach_outputs(hyp(spark, d), utt(spark, d).select("utt_id", "ref"))
    return heard.groupBy("system").agg(corpus_wer("ref", "hyp").alias("wer"))


def raw_and_full(spark, d):
    """The same outputs against the raw and against the normalised truth."""
    outputs = hyp(spark, d)
    truth = utt(spark, d).select("utt_id", F.col("text").alias("ref"))
    raw = wer_by_system(outputs, truth).select(F.lit("raw").alias("form"), "system", "wer")
    full = wer_by_system(outputs, truth, normalize_full).select(F.lit("full").alias("form"), "system", "wer")
    return raw.unionByName(full)


def by_system(spark, d):
    return wer_by_system(hyp(spark, d), utt(spark, d))


def of_columns(spark, d):
    scores = wer_of_columns(wide(spark, d), "ref", SYSTEMS)
    return scores.select("system", percent(F.col("wer") / 100).alias("wer"))


def voted_first(spark, d):
    return rover(wide(spark, d), SYSTEMS, "first").select("utt_id", "rover")


def voted_words(spark, d):
    return rover(wide(spark, d), SYSTEMS, "word_over_null").select("utt_id", "rover")


def voted_network(spark, d):
    made = rover(wide(spark, d), SYSTEMS, "word_over_null", align="network")
    return made.select("utt_id", "rover")


def of_voted(spark, d):
    """Votes scored in the plan that makes them, with what the rates are made of."""
    voted = rover(wide(spark, d), SYSTEMS, "word_over_null")
    return wer_of_columns(voted, "ref", [*SYSTEMS, "rover"], normalize_full, counts=True)


def latency(spark, d):
    timings = table(spark, d, "events").select(
        F.col("event_type").alias("system"), F.col("value").cast("decimal(18,4)").alias("seconds")
    )
    ratio = latency_compare(timings, "view", "click")
    return ratio.select([F.round(F.col(c).cast("double"), 4).alias(c) for c in ratio.columns])


def _log(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("wer")
    )


def least(spark, d):
    return best_run(_log(spark, d))


def greatest(spark, d):
    return best_run(_log(spark, d), greater_is_better=True)


def checkpoint(spark, d):
    name = F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string"))
    return latest_checkpoint(table(spark, d, "orders").select(name.alias("name")))


def user_scores(spark, d):
    def make_stub():
        """A stand-in for a model: counts characters, fails on one letter."""

        def stub(frame):
            if frame["text"].str.contains("ß").any():
                raise ValueError("cannot read this letter")
            return frame[["text"]].assign(n_chars=frame["text"].str.len())[["n_chars"]]

        return stub

    rows = utt(spark, d).select("utt_id", "text")
    return score_batches(rows, make_stub, ["text"], "n_chars long", keep=["utt_id"])


#: CTE `pairs(k, r, h)` of all systems against the truth.
SQL_KEYED_PAIRS = f"""pairs as materialized (
  select utt_id || '/' || system as k, {sql_words('ref')} r, {sql_words('hyp')} h
  from hyp join utt using (utt_id))"""

SQL_ALL_PAIRS = f"""pairs as materialized (
  select utt_id as k, system, {sql_words('ref')} r, {sql_words('hyp')} h
  from hyp join utt using (utt_id))"""


def sql_rover(over_null: bool) -> str:
    """CTE `voted(utt_id, rover)`: scripts against system a, one vote per system and slot."""
    favoured = "word <> '' desc," if over_null else ""
    return f"""pairs as materialized (
      select utt_id || '/' || rank as k, {sql_words('a')} r, {sql_words('h')} h from (
        select utt_id, a, b as h, 1 as rank from wide
        union all select utt_id, a, c, 2 from wide)),
    {sql_scripts('pairs')},
    steps as (
      select k, h, unnest(range(1, length(script)+1)) as t, script from scripts),
    lettered as (select k, h, t, script[t] as letter from steps),
    placed as (
      select *, (sum((letter <> 'I')::int) over w)::bigint as pos,
        (sum((letter <> 'D')::int) over w)::bigint as hi
      from lettered window w as (partition by k order by t)),
    said as (
      select split_part(k,'/',1) as utt_id, split_part(k,'/',2)::int as rank, pos,
        case when letter = 'I'
          then row_number() over (partition by k, pos, letter = 'I' order by t) else 0 end as ins,
        case when letter = 'D' then '' else h[hi] end as word from placed
      union all
      select utt_id, 0, i, 0, ({sql_words('a')})[i]
      from (select utt_id, a, unnest(range(1, len({sql_words('a')})+1)) as i from wide)),
    slots as (select distinct utt_id, pos, ins from said),
    ballots as (
      select s.utt_id, s.pos, s.ins, v.rank, coalesce(x.word, '') as word
      from slots s cross join (select unnest([0,1,2]) as rank) v
      left join said x on x.utt_id = s.utt_id and x.pos = s.pos and x.ins = s.ins
        and x.rank = v.rank),
    counted as (
      select utt_id, pos, ins, word, count(*) as n, min(rank) as rank from ballots group by all),
    winners as (
      select * from counted qualify row_number() over (
        partition by utt_id, pos, ins order by n desc, {favoured} rank) = 1),
    texts as (
      select utt_id, string_agg(word, ' ' order by pos, ins) as rover
      from winners where word <> '' group by utt_id),
    voted as (
      select w.utt_id, coalesce(t.rover, '') as rover from wide w left join texts t using (utt_id))"""


SQL_NETWORK = f"""pairs as materialized (
      select utt_id as k, {sql_words('a')} r, {sql_words('b')} h from wide),
    {sql_scripts('pairs')},
    first_steps as (select k, r, h, unnest(range(1, length(script)+1)) as t, script from scripts),
    first_letters as (
      select k, r, h, t, script[t] as letter,
        length(replace(script[1:t],'I','')) as pos, length(replace(script[1:t],'D','')) as hi
      from first_steps),
    first_slots as (
      select k, list(case letter when 'A' then [r[pos], h[hi]] when 'D' then [r[pos], '']
        else ['', h[hi]] end order by t) as slots from first_letters group by k),
    onto as materialized (
      select utt_id as k, coalesce(slots, []) as r, {sql_words('c')} h,
        list_reverse(coalesce(slots, [])) as rr, list_reverse({sql_words('c')}) as hr,
        list_transform(list_reverse(coalesce(slots, [])),
          lambda s: case when list_contains(s, '') then 0 else 1 end) as skip
      from wide left join first_slots on k = utt_id),
    over(k, n, p) as (
      select k, 0, list_transform(range(0, len(r)+1),
        lambda i: coalesce(list_sum(skip[1:i]), 0)::bigint) from onto
      union all
      select k, n+1, list_reduce(range(1, len(rr)+1), lambda q,i:
          list_append(q, least(p[i] + case when list_contains(rr[i], w) then 0 else 1 end,
            p[i+1]+1, q[-1]+skip[i])),
          [p[1]+1])
      from (select g.k, g.n, g.p, x.rr, x.skip, x.hr[g.n+1] w
            from over g join onto x on g.k = x.k and g.n < len(x.hr))),
    left_over as (select k, list(p order by n) m from over group by k),
    second as (
      select k, r, h, list_reduce(range(0, len(r)+len(h)), lambda s,step:
        case when s.i > len(r) and s.j > len(h) then s
          when s.i <= len(r) and s.j <= len(h)
            and m[len(h)-s.j+1][len(r)-s.i+1]
              + case when list_contains(r[s.i], h[s.j]) then 0 else 1 end
              = m[len(h)-s.j+2][len(r)-s.i+2]
            then {{'i': s.i+1, 'j': s.j+1, 's': s.s||'A'}}
          when s.i <= len(r)
            and m[len(h)-s.j+2][len(r)-s.i+1]
              + case when list_contains(r[s.i], '') then 0 else 1 end
              = m[len(h)-s.j+2][len(r)-s.i+2]
            then {{'i': s.i+1, 'j': s.j, 's': s.s||'D'}}
          else {{'i': s.i, 'j': s.j+1, 's': s.s||'I'}} end,
        {{'i': 1::bigint, 'j': 1::bigint, 's': ''}}).s as script
      from onto join left_over using (k)),
    second_steps as (select k, r, h, unnest(range(1, length(script)+1)) as t, script from second),
    second_letters as (
      select k, r, h, t, script[t] as letter,
        length(replace(script[1:t],'I','')) as pos, length(replace(script[1:t],'D','')) as hi
      from second_steps),
    filled as (
      select k, t, case letter when 'A' then list_append(r[pos], h[hi])
        when 'D' then list_append(r[pos], '') else ['', '', h[hi]] end as slot
      from second_letters),
    ballots as (select k, t, unnest([1,2,3]) as rank, slot from filled),
    counted as (
      select k, t, slot[rank] as word, count(*) as n, min(rank) as rank from ballots group by all),
    winners as (
      select * from counted qualify row_number() over (
        partition by k, t order by n desc, word <> '' desc, rank) = 1),
    texts as (
      select k, string_agg(word, ' ' order by t) as rover from winners where word <> '' group by k)"""


QUERIES = {
    "word_edits": (
        edits,
        f"""with {SQL_UTT}, {SQL_HYP}, {SQL_ALL_PAIRS}
        select k as utt_id, system, {SQL_EDITS}::int as edits, len(r)::int as ref_words
        from pairs""",
    ),
    "align_words": (
        scripts,
        f"""with recursive {SQL_UTT}, {SQL_HYP}, {SQL_KEYED_PAIRS}, {sql_scripts('pairs')}
        select split_part(k,'/',1) as utt_id, split_part(k,'/',2) as system, script from scripts""",
    ),
    "edit_detail": (
        detail,
        f"""with recursive {SQL_UTT}, {SQL_HYP}, {SQL_KEYED_PAIRS}, {sql_scripts('pairs')},
        c as (select *, length(script) - length(replace(script,'D','')) as d,
          length(script) - length(replace(script,'I','')) as i, {SQL_EDITS} as e from scripts)
        select split_part(k,'/',1) as utt_id, split_part(k,'/',2) as system, e::int as edits, (e-d-i)::int as substitutions, d::int as deletions,
          i::int as insertions, len(r)::int as ref_words from c""",
    ),
    "corpus_wer": (
        pooled,
        f"""with {SQL_UTT}, {SQL_HYP}, {SQL_ALL_PAIRS}
        select system, 100.0::double * sum({SQL_EDITS}) / sum(len(r)) as wer from pairs group by system""",
    ),
    "wer_raw_and_normalized": (
        raw_and_full,
        f"""with {SQL_UTT}, {SQL_HYP}, pairs as materialized (
          select 'raw' as form, system, {sql_raw_words('text')} r, {sql_words('hyp')} h
          from hyp join utt using (utt_id)
          union all
          select 'full', system, {sql_words('ref')}, {sql_words('hyp')}
          from hyp join utt using (utt_id))
        select form, system, 100.0::double * sum({SQL_EDITS}) / sum(len(r)) as wer from pairs
        group by form, system""",
    ),
    "wer_by_system": (
        by_system,
        f"""with {SQL_UTT}, {SQL_HYP}, {SQL_ALL_PAIRS},
        e as (select system, len(r) n, {SQL_EDITS} e from pairs)
        select system, count(*) as utterances, sum(n)::bigint as ref_words,
          sum(e)::bigint as edits, 100.0::double * sum(e) / sum(n) as wer,
          round(100.0::double * sum(e) / sum(n), 2) as wer_2 from e group by system""",
    ),
    "wer_of_columns": (
        of_columns,
        f"""with {SQL_UTT}, {SQL_HYP}, {SQL_ALL_PAIRS}
        select system, round(100.0::double * sum({SQL_EDITS}) / sum(len(r)), 2) as wer
        from pairs group by system""",
    ),
    "rover_first": (
        voted_first,
        f"""with recursive {SQL_UTT}, {SQL_HYP}, {SQL_WIDE}, {sql_rover(False)}
        select utt_id, rover from voted""",
    ),
    "rover_word_over_null": (
        voted_words,
        f"""with recursive {SQL_UTT}, {SQL_HYP}, {SQL_WIDE}, {sql_rover(True)}
        select utt_id, rover from voted""",
    ),
    "rover_network": (
        voted_network,
        f"""with recursive {SQL_UTT}, {SQL_HYP}, {SQL_WIDE}, {SQL_NETWORK}
        select utt_id, coalesce(rover, '') as rover from wide left join texts on k = utt_id""",
    ),
    "wer_of_rover": (
        of_voted,
        f"""with recursive {SQL_UTT}, {SQL_HYP}, {SQL_WIDE}, {sql_rover(True)},
        scored as (
          select 'a' as system, ref, a as hyp from wide
          union all select 'b', ref, b from wide
          union all select 'c', ref, c from wide
          union all select 'rover', ref, rover from wide join voted using (utt_id)),
        lists as materialized (select system, {sql_words('ref')} r, {sql_words('hyp')} h from scored),
        e as (select system, len(r) n, {SQL_EDITS} e from lists)
        select system, count(*) as utterances, sum(n)::bigint as ref_words,
          sum(e)::bigint as edits, 100.0::double * sum(e) / sum(n) as wer from e group by system""",
    ),
    "latency_compare": (
        latency,
        """with m as (
          select avg(value) filter (event_type='view') as b,
                 avg(value) filter (event_type='click') as o from events)
        select round(b, 4) as base_seconds, round(o, 4) as other_seconds,
          round(b / o, 4) as speedup from m""",
    ),
    "best_run": (
        least,
        """select user_id as run, arg_min(event_id, {'v': value, 'e': event_id}) as best_step,
        min(value) as best_metric from events group by user_id""",
    ),
    "best_run_greatest": (
        greatest,
        """select user_id as run, arg_min(event_id, {'v': -value, 'e': event_id}) as best_step,
        max(value) as best_metric from events group by user_id""",
    ),
    "latest_checkpoint": (
        checkpoint,
        """select 'checkpoint-' || max(o_orderkey) as name, max(o_orderkey) as step
        from orders""",
    ),
    "score_batches": (
        user_scores,
        f"""with {SQL_UTT} select utt_id,
        case when not contains(text, 'ß') then length(text) end as n_chars,
        case when contains(text, 'ß') then 'ValueError: cannot read this letter' end as error
        from utt""",
    ),
}

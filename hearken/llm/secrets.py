"""Secret scans in DataFrame functions alone: fixed patterns, and sliding-window entropy.

Three patterns give the base spans. Beside them, candidate strings (runs of 20 and more token
characters with letters and digits) are scanned for randomness: a window of fixed width slides
over a candidate, the counts of the character that enters and of the one that leaves change, and
windows of high Shannon entropy for their character class become spans. The allow-list has two
parts: candidates that begin or end with a placeholder word are left out as a whole, and windows
that hold a sequence, a long word and the like are left out alone, so that a long key is not
lost for what some place in it looks like.

Entropy is kept in whole numbers: with c occurrences of each character in a window of W,
H = log2 W - (sum of c log2 c) / W, where c log2 c is rounded to 2^-32. A step changes the sum by
table differences at two counts, taken from the window before it; the changes are then added up.
All lists are walked a fixed number of times, so work grows with the length of a candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the patterns of the base spans
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

WINDOW = 20
# kind, characters of a candidate, least entropy of a window in bits
CLASSES = (
    ("entropy_hex", "0-9a-fA-F", 3.05),
    ("entropy_token", "A-Za-z0-9+/_-", 3.65),
)
# candidates that are no secrets, by how they begin or end
PLACEHOLDER = (
    r"(?i)^(example|sample|dummy|placeholder|change_?me|your[_-]|test[_-]|xxxx|https?/|www/)|"
    r"(example|sample|dummy|placeholder)[_-]?(key|token|secret)?$"
)
# windows that are no secrets
ORDINARY = (
    r"(?i)xxxx|01234|12345|abcdef|qwerty|^[0-9/_-]+$|^[^0-9]+$|"
    r"^[0-9]*[A-Za-z]+[0-9]{0,4}$|[A-Za-z]{16}"
)
# sums of lengths are kept in blocks, so that long lists of matches cost no square
BLOCK = 256


def running_sums(values: str) -> str:
    """SQL for the sums of `values` up to and including each element."""
    inner = (
        "aggregate({0}, named_struct('sum', 0L, 'all', cast(array() as array<bigint>)), "
        "(acc, v) -> named_struct('sum', acc.sum + v, 'all', array_append(acc.all, acc.sum + v)), "
        "acc -> acc.all)"
    )
    blocks = (
        f"transform(sequence(0, (size({values}) - 1) div {BLOCK}), "
        f"b -> slice({values}, b * {BLOCK} + 1, {BLOCK}))"
    )
    totals = f"transform({blocks}, q -> aggregate(q, 0L, (s, v) -> s + v))"
    ahead = inner.format(totals)
    return (
        f"if(size({values}) = 0, cast(array() as array<bigint>), flatten(zip_with({blocks}, "
        f"zip_with({ahead}, {totals}, (t, own) -> t - own), "
        f"(q, base) -> transform({inner.format('q')}, x -> x + base))))"
    )


def _with_matches(df: DataFrame, name: str, pattern: str, test: str) -> DataFrame:
    """Column `name`: array of (start, end, value) of all matches, `end` exclusive.

    What is between matches and the matches themselves follow each other, so their lengths
    in code points give the places. `test` is a cheap pattern that every text with a match has.
    """
    has = F.col("text").rlike(test)
    none = F.expr("cast(null as array<string>)")
    df = df.withColumn(
        f"{name}_found",
        F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none),
    ).withColumn(f"{name}_gaps", F.when(has, F.split("text", pattern, -1)).otherwise(none))
    steps = (
        f"transform({name}_found, (m, i) -> cast(char_length({name}_gaps[i]) + "
        f"if(i = 0, 0, char_length({name}_found[greatest(i - 1, 0)])) as bigint))"
    )
    df = df.withColumn(f"{name}_steps", F.expr(steps))
    starts = running_sums(f"{name}_steps")
    return df.withColumn(
        name,
        F.expr(
            f"zip_with({starts}, {name}_found, (s, m) -> named_struct("
            "'start', s, 'end', s + char_length(m), 'value', m))"
        ),
    ).drop(f"{name}_found", f"{name}_gaps", f"{name}_steps")


def _spans(name: str, kind: str, rank: int, keep: str) -> Column:
    return F.expr(
        f"transform(filter(coalesce({name}, array()), x -> {keep}), x -> named_struct("
        f"'start', x.start, 'rank', {rank}, 'end', x.end, 'kind', '{kind}'))"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL for `body`, in which `name` is `value`, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _escaped(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _entropy_runs(bits: float) -> str:
    """SQL for the joined high-entropy windows of x.value, as (a, z) within it."""
    scale = 1 << 32
    table = [round(c * math.log2(c) * scale) if c else 0 for c in range(WINDOW + 2)]
    f = "array(" + ",".join(f"{v}L" for v in table) + ")"
    limit = math.floor(WINDOW * (math.log2(WINDOW) - bits) * scale)
    times = lambda ch: f"(char_length(w) - char_length(replace(w, {ch}, '')))"
    # of the window before: how often it has the character that leaves, and the one that enters
    entering = f"({times('chars[i]')} - if(i >= {WINDOW} and l = chars[i], 1, 0))"
    change = (
        f"{f}[{entering} + 1] - {f}[{entering}] "
        f"+ if(i < {WINDOW}, 0L, {f}[{times('l')} - 1] - {f}[{times('l')}])"
    )
    before = f"array_join(slice(chars, greatest(i - {WINDOW}, 0) + 1, least(i, {WINDOW})), '')"
    changes = (
        "transform(sequence(0, size(chars) - 1), i -> "
        + _let("w", before, _let("l", f"chars[greatest(i - {WINDOW}, 0)]", change))
        + ")"
    )
    # the last characters of windows that are random and not ordinary
    ends = (
        f"filter(sequence({WINDOW - 1}, size(chars) - 1), i -> sums[i] <= {limit}L and not "
        f"array_join(slice(chars, i - {WINDOW - 2}, {WINDOW}), '') rlike '{_escaped(ORDINARY)}')"
    )
    first = f"filter(ends, (e, k) -> k = 0 or e - ends[greatest(k - 1, 0)] > {WINDOW})"
    last = f"filter(ends, (e, k) -> k = size(ends) - 1 or get(ends, k + 1) - e > {WINDOW})"
    runs = (
        f"zip_with({first}, {last}, (a, z) -> named_struct('a', a - {WINDOW - 1}, 'z', z + 1))"
    )
    chars = "filter(split(x.value, ''), ch -> ch <> '')"
    return _let(
        "chars",
        chars,
        _let("changes", changes, _let("sums", running_sums("changes"), _let("ends", ends, runs))),
    )


def _entropy_spans(name: str, kind: str, rank: int, bits: float) -> Column:
    candidates = f"filter(coalesce({name}, array()), x -> not x.value rlike '{_escaped(PLACEHOLDER)}')"
    return F.expr(
        f"flatten(transform({candidates}, x -> transform({_entropy_runs(bits)}, r -> "
        f"named_struct('start', x.start + r.a, 'rank', {rank}, 'end', x.start + r.z, "
        f"'kind', '{kind}'))))"
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Add `spans` to `docs(text, ..)`: all found places, ordered, in code points.

    An element is (start, rank, end, kind), `end` exclusive. Kinds by rank: assign, access, hex
    (the base, all matches of their patterns that are long enough), entropy_hex,
    entropy_token. A null or empty text has none. Narrow: no shuffle, no Python; rows, repeated
    or not, are independent of each other. Columns of `docs` are kept.
    """
    named = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(named.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    df = _with_matches(df, "assign", ASSIGN, r"(?i)passw|secret|token|api_?key")
    df = _with_matches(df, "access", ACCESS, "AKIA[A-Z0-9]{12}")
    df = _with_matches(df, "hex", f"(?<![0-9a-f]){HEX[:-1]}{{32,}}", "[0-9a-f]{32}")
    arrays = [
        _spans(
            "assign",
            "assign",
            0,
            f"char_length(regexp_extract(x.value, '{_escaped(ASSIGN)}', 2)) >= 8",
        ),
        _spans("access", "access", 1, "char_length(x.value) >= 16"),
        _spans("hex", "hex", 2, "char_length(x.value) >= 32"),
    ]
    for rank, (kind, characters, bits) in enumerate(CLASSES, 3):
        pattern = f"(?<![{characters}])[{characters}]{{{WINDOW},}}"
        df = _with_matches(df, kind, pattern, pattern)
        arrays.append(_entropy_spans(kind, kind, rank, bits))
    df = df.select("row", F.array_sort(F.concat(*arrays)).alias("spans"))
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns], "spans")


def joined(spans: str, keep: str = "true") -> Column:
    return F.expr(
        f"array_join(transform(filter({spans}, x -> {keep}), "
        "x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of `docs(doc_id, text, ..)` the numbers of base spans and all spans as text."""
    found = secret_spans(docs.select("doc_id", "text"))
    count = lambda rank: F.expr(f"cast(size(filter(spans, x -> x.rank = {rank})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined("spans", "x.rank < 3"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )

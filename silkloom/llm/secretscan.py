"""Secret scans: patterns of known secrets, and windows of high entropy in strings that look like keys.

Candidate strings are the maximal runs of a character class. A window of fixed length slides along each; its Shannon
entropy follows from the counts of its characters, which change by one character that enters and one that leaves, so
a string of any length takes linear time. Windows above the class's threshold that hold the kinds of characters it asks
for make spans. Strings of the allow-list make none. Pattern matches always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices, table, task

KINDS = ("assign", "access", "hex", "entropy")

#: Fixed values of the contract. Runs that are too short to count would end at the same places, so only long ones are looked for; an assignment's value is measured after the match, as a dropped match still uses up its characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")

#: Characters of a window, and the unit that entropies are counted in, so that sums are whole numbers.
WINDOW, UNIT = 20, 1 << 20
#: c * log2(c) in units, for the counts that a window can have.
WEIGHT = [0, *(round(c * log2(c) * UNIT) for c in range(1, WINDOW + 1))]


@dataclass(frozen=True)
class Class:
    """A character class: its runs, the least entropy of a window in bits, and sets of characters of which a window needs one each."""

    name: str
    run: re.Pattern
    bits: float
    needs: tuple[str, ...]

    @property
    def most(self) -> int:
        """The largest sum of WEIGHT over a window's counts at that entropy: log2(WINDOW) less the sum's share per character is the entropy."""
        return int((log2(WINDOW) - self.bits) * WINDOW * UNIT)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    Class("hexadecimal", re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}"), 2.9, (DIGITS, "abcdefABCDEF")),
    Class("upper", re.compile(r"(?<![A-Z0-9])[A-Z0-9]{20,}"), 3.6, (DIGITS, UPPER)),
    Class("base64", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"), 3.8, (DIGITS, LOWER, UPPER)),
)

#: What is known to be no secret: (pattern of the string, pattern of the 16 characters before it).
ALLOWED = (
    (re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"), re.compile("")),  # universally unique identifiers
    (re.compile(r".*"), re.compile(r"(://|www\.)[^\x20\x09-\x0D]*\Z")),  # addresses
    (re.compile(r"//.*"), re.compile(r":\Z")),
    (re.compile(r".*"), re.compile(r"(sha1|sha256|sha512|md5|commit)[:=\x20-]\x20?\Z", re.ASCII | re.IGNORECASE)),  # digests that are named so
    (re.compile(r".*(example|placeholder|changeme|xxxx|0123456789|abcdefghij).*", re.ASCII | re.IGNORECASE), re.compile("")),  # samples
)
LOOK_BACK = 16


def allowed(text: str, start: int, end: int) -> bool:
    before = text[max(0, start - LOOK_BACK) : start]
    return any(whole.fullmatch(text, start, end) and ahead.search(before) for whole, ahead in ALLOWED)


def windows(run: str, kind: Class) -> Iterator[tuple[int, int]]:
    """Spans within a run: stretches of overlapping or touching windows whose entropy reaches the class's threshold."""
    counts: dict[str, int] = {}
    have = [0] * len(kind.needs)
    total, most, begun, upto = 0, kind.most, None, 0
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += WEIGHT[n + 1] - WEIGHT[n]
        for k, those in enumerate(kind.needs):
            have[k] += c in those
        first = i + 1 - WINDOW
        if first < 0:
            continue
        if total <= most and all(have):
            if begun is not None and first > upto:
                yield begun, upto
                begun = None
            begun, upto = first if begun is None else begun, i + 1
        out = run[first]
        counts[out] -= 1
        total -= WEIGHT[counts[out] + 1] - WEIGHT[counts[out]]
        for k, those in enumerate(kind.needs):
            have[k] -= out in those
    if begun is not None:
        yield begun, upto


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the pattern matches."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def entropy_spans(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the entropy spans that no pattern match holds; spans of several classes that overlap are one."""
    found = sorted(
        (run.start() + a, run.start() + b)
        for kind in CLASSES
        for run in kind.run.finditer(text)
        if not allowed(text, run.start(), run.end())
        for a, b in windows(run.group(), kind)
    )
    merged: list[list[int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, 3, b) for a, b in merged if not any(s <= a and b <= e for s, _, e in base)]


def scanned(text: str | None) -> list[dict]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return [{"start": a, "kind": k, "end": b} for a, k, b in sorted(base + entropy_spans(text, base))]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])


@F.arrow_udf(T.ArrayType(_SPAN))
def spans_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    with task():
        yield from by_slices(texts, lambda part: [scanned(t) for t in part], _SPANS)


def scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: ``row`` (struct of the carried columns; all, by default) and ``spans``, an array of (start, kind, end) in code points, end exclusive.

    kind numbers KINDS. Null and empty texts have no spans; texts of any length are scanned whole; repeated rows give
    repeated rows and an empty table none. Columns of docs cannot clash, as they stay inside ``row``.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), spans_of(F.col(f"`{text_col}`")).alias("spans"))


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced by a mark; overlapping spans are one."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s in scanned(text):
            if s["start"] >= at:
                out += [text[at : s["start"]], mark]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    @F.arrow_udf(T.StringType())
    def cleaned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with task():
            yield from by_slices(texts, lambda part: [clean(t) for t in part], pa.string())

    return docs.withColumn(text_col, cleaned(F.col(f"`{text_col}`")))


def op12_secret_scan(spark, sf_dir):
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = joined(F.filter("spans", lambda s: s["kind"] < 3))
    return rows.select("row.doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op12_secret_scan": op12_secret_scan}

_ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _tokens(name: str, pattern: str, more: str = "") -> str:
    """SQL: a text cut into matches of a pattern and what lies between, with the start of each piece."""
    return f"""{name} AS (SELECT id, text, piece, CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY i) - length(piece) AS BIGINT) AS pos FROM (
  SELECT id, text, unnest(regexp_extract_all(text, '{pattern}')) AS piece, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM d){more})"""


def _runs(name: str, chars: str, least: int) -> str:
    return f"{_tokens(name + '_all', f'[{chars}]+|[^{chars}]+')}, {name} AS (SELECT id, text, piece, pos FROM {name}_all WHERE length(piece) >= {least} AND regexp_matches(piece, '^[{chars}]'))"


_CASES = [("c1", "0-9A-Fa-f", CLASSES[0], ("[0-9]", "[a-fA-F]")), ("c2", "A-Z0-9", CLASSES[1], ("[0-9]", "[A-Z]")), ("c3", "A-Za-z0-9+/_-", CLASSES[2], ("[0-9]", "[a-z]", "[A-Z]"))]
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WINDOWS = " UNION ALL ".join(
    f"SELECT id, pos + i AS a FROM (SELECT id, pos, piece, unnest(range(0, length(piece) - {WINDOW - 1})) AS i FROM {name}_ok) WHERE "
    + " AND ".join(f"regexp_matches(substr(piece, CAST(i AS INT) + 1, {WINDOW}), '{n}')" for n in needs)
    + f" AND list_sum(list_transform(map_values(list_histogram(string_split(substr(piece, CAST(i AS INT) + 1, {WINDOW}), ''))), lambda c: {WEIGHT}[CAST(c + 1 AS INT)])) <= {kind.most}"
    for name, _, kind, needs in _CASES
)
_OK = ", ".join(
    f"""{name}_ok AS (SELECT id, pos, piece FROM {name} WHERE NOT regexp_full_match(piece, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}')
  AND NOT regexp_matches(substr(text, CAST(greatest(0, pos - 16) AS INT) + 1, CAST(least(pos, 16) AS INT)), '(://|www\\.)[^\\x20\\x09-\\x0D]*$')
  AND NOT (starts_with(piece, '//') AND substr(text, CAST(pos AS INT), 1) = ':')
  AND NOT regexp_matches({_FOLD.format('substr(text, CAST(greatest(0, pos - 16) AS INT) + 1, CAST(least(pos, 16) AS INT))')}, '(sha1|sha256|sha512|md5|commit)[:=\\x20-]\\x20?$')
  AND NOT regexp_matches({_FOLD.format('piece')}, 'example|placeholder|changeme|xxxx|0123456789|abcdefghij'))"""
    for name, *_ in _CASES
)

ORACLE_SQL = {
    "op12_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
{_tokens('t0', '(?s)' + _ASSIGN + '|[^pPsStTaA]+|.')}, {_tokens('t1', '(?s)AKIA[A-Z0-9]+|[^A]+|.')}, {_runs('t2', '0-9a-f', 24)},
base AS (SELECT id, 0 AS kind, pos AS a, pos + length(piece) AS b FROM t0 WHERE regexp_full_match(piece, '{_ASSIGN}') AND length(regexp_extract(piece, '{_ASSIGN}', 2)) >= {ASSIGN_VALUE}
  UNION ALL SELECT id, 1, pos, pos + length(piece) FROM t1 WHERE regexp_full_match(piece, 'AKIA[A-Z0-9]+') AND length(piece) >= 20
  UNION ALL SELECT id, 2, pos, pos + length(piece) FROM t2),
{', '.join(_runs(name, chars, WINDOW) for name, chars, *_ in _CASES)}, {_OK},
w AS (SELECT DISTINCT id, a FROM ({_WINDOWS})),
isle AS (SELECT id, a, count(*) FILTER (gap) OVER (PARTITION BY id ORDER BY a) AS n FROM (SELECT id, a, coalesce(a > lag(a) OVER (PARTITION BY id ORDER BY a) + {WINDOW}, true) AS gap FROM w)),
extra AS (SELECT id, 3 AS kind, min(a) AS a, max(a) + {WINDOW} AS b FROM isle GROUP BY id, n),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra x WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.id = x.id AND base.a <= x.a AND x.b <= base.b)),
said AS (SELECT id, kind, a, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || b AS s FROM every)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN said USING (id) GROUP BY id, doc_id
"""
}

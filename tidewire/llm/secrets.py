"""Secret scans over a trigram inverted index.

A rule is a regular expression. From its parsed form a Boolean query over trigrams is
derived that every match must satisfy. The index holds one posting per trigram and
document for the trigrams that the rules ask for; intersecting postings gives the
candidate documents of each rule, and only those are verified with the expression. Rules
without a mandatory trigram scan every text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut, join_small, let, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java and Python. A match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: What may stand between the pieces of a key's body: white space, escaped line ends, quotes of mails and of source text.
_GAP = r"""\x20\t\r\n\\"'>,"""
_BASE64 = "A-Za-z0-9+/="
#: 16 or more, written out: DuckDB does not nest counts whose product is over 1000.
_RUN = f"[{_BASE64}]" * 16 + f"[{_BASE64}]*"
_FIELDS = r"(?:[\x20\t\r\n\\]+[A-Za-z0-9-]+:\x20[^\x20\t\r\n\\]+){0,8}"
#: A private key from its header to its END line; without one, to the end of the base64 runs of 16 characters or more
#: behind the header (a padded run may be shorter). The runs are possessive: Java would recurse for each of them otherwise.
KEY_BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    rf"(?:{_FIELDS}[{_BASE64}{_GAP}]*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|{_FIELDS}[{_GAP}]*{_RUN}(?:[{_GAP}]+{_RUN})*+(?:[{_GAP}]+[A-Za-z0-9+/]+=+)?)?"
)

#: Base rules in the order in which spans that start together are listed, and those that this library adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", KEY_BLOCK),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
)
BASE = ("assign", "access", "hex")

#: A set of literals may grow to this size before it counts as unknown.
MOST_LITERALS = 64


def _concat(parts: list[frozenset | None]) -> list[frozenset]:
    """Runs of literal sets that follow each other, joined; None breaks a run."""
    runs: list[frozenset] = [frozenset({""})]
    for p in parts:
        if p is None:
            runs.append(frozenset({""}))
        else:
            joined = frozenset(a + b for a, b in product(runs[-1], p))
            runs = [*runs[:-1], joined] if len(joined) <= MOST_LITERALS else [*runs, p]
    return runs


def trigram_query(pattern: str) -> list[list[frozenset]] | None:
    """Clauses, all mandatory, each a choice of trigram sets of which one must be posted; None if nothing is mandatory.

    Letters are folded to lower case on both sides, so one index serves rules of either case.
    """
    clauses: list[list[frozenset]] = []

    def literals(seq) -> list[frozenset | None]:
        parts: list[frozenset | None] = []
        for op, arg in seq:
            if op is sre.LITERAL:
                parts.append(frozenset({chr(arg).lower()}))
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                parts.append(frozenset(chr(a).lower() for _, a in arg))
            elif op is sre.SUBPATTERN:
                parts.extend(literals(arg[3]))
            elif op is sre.BRANCH:
                options = [_concat(literals(b)) for b in arg[1]]
                parts.append(frozenset().union(*(o[0] for o in options)) if all(len(o) == 1 for o in options) else None)
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
                inner = _concat(literals(arg[2]))
                parts.append(inner[0] | {""} if len(inner) == 1 else None)
            elif op is sre.MAX_REPEAT and arg[0] == arg[1]:
                parts.extend(literals(arg[2]) * arg[0])
            elif op is sre.MAX_REPEAT and arg[0] > 0:
                parts.extend([*(literals(arg[2]) * arg[0]), None])
            else:
                parts.append(None)
        return parts

    for run in _concat(literals(sre_parser.parse(pattern))):
        choices = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(run)]
        if all(choices):
            clauses.append([c for c in dict.fromkeys(choices) if not any(o < c for o in choices)])
    return clauses or None


def needed_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) or [] for choice in clause for t in choice})


def _key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash")]


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id, text_hash) of the trigrams that the rules ask for."""
    low = F.lower(text_or_empty())
    asked = needed_trigrams(rules)
    if not asked:
        return docs.select(F.lit("").alias("trigram"), *_key()).limit(0)
    posted = let(low, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in asked])))
    return docs.select(F.explode(posted).alias("trigram"), *_key())


#: Trigrams of one long integer in the row of a document.
WORD_BITS = 63


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_hash, kinds): the rules whose Boolean query a document's postings satisfy."""
    asked = needed_trigrams(rules)
    if not asked:
        return index.select("doc_id", "text_hash", F.array().cast("array<string>").alias("kinds")).limit(0)
    number = F.create_map(*[x for i, g in enumerate(asked) for x in (F.lit(g), F.lit(i))])[F.col("trigram")]
    words = range(0, len(asked), WORD_BITS)
    bit = lambda lo: F.when((number >= lo) & (number < lo + WORD_BITS), F.expr("1L") * F.pow(F.lit(2), number - lo).cast("long"))
    posted = index.groupBy("doc_id", "text_hash").agg(*[F.coalesce(F.bit_or(bit(lo)), F.lit(0).cast("long")).alias(f"posted_{lo}") for lo in words])

    def holds(choice: frozenset) -> Column:
        met = F.lit(True)
        for lo in words:
            mask = sum(1 << (i - lo) for i in map(asked.index, choice) if lo <= i < lo + WORD_BITS)
            if mask:
                met = met & (F.col(f"posted_{lo}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        return met

    met = []
    for r in rules:
        if query := trigram_query(r.pattern):
            met.append(F.when(reduce(Column.__and__, [reduce(Column.__or__, map(holds, clause)) for clause in query]), F.lit(r.kind)))
    kinds = F.array_compact(F.array(*met))
    return posted.select("doc_id", "text_hash", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Per entry of an array of integers the sum (or what ``add`` makes) of all up to it.

    An array cannot grow without being copied, so entries are taken in blocks whose number is
    about their size.
    """

    def grown(block: Column) -> Column:
        begin = F.array().cast("array<int>")
        return F.aggregate(block, begin, lambda acc, x: F.concat(acc, F.array(F.coalesce(add(F.get(acc, F.size(acc) - 1), x), x))))

    def of_blocks(blocks: Column) -> Column:
        lasts = grown(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        before = lambda ends, k: F.get(ends, k - 1)
        return let(lasts, lambda ends: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: F.coalesce(add(before(ends, k), x), x)))))

    def running(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut_up = lambda n: F.transform(F.sequence(F.lit(0), F.size(v) - 1, n), lambda i: grown(F.slice(v, i + 1, n)))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(let(size, cut_up), of_blocks))

    return let(values, running)


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost matches that do not overlap, as structs (start, end, kind) in code points.

    The text between matches gives the places: a match starts where the gaps and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    none = F.array().cast(SPANS)

    def placed(hits: Column) -> Column:
        judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
        gaps = F.split(text, rule.pattern, -1)
        sizes = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))), judged, lambda x, j: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), (F.length(j) >= rule.least).alias("counts")))

        def spans(rows: Column) -> Column:
            ends = _running(F.transform(rows, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b)
            span = lambda x, end: F.when(x["counts"], F.struct((end - x["hit"]).alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
            return F.array_compact(F.zip_with(rows, ends, span))

        return F.when(F.size(hits) > 0, let(sizes, spans)).otherwise(none)

    return let(found, placed)


SPANS = "array<struct<start:int,end:int,kind:string>>"


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, and ``spans`` per kind in ``found`` (a map from kind to spans).

    The postings are written once; candidates are few in most corpora, and their table is
    broadcast if it proves small, so that texts are not shuffled.
    """
    indexed = [r for r in rules if trigram_query(r.pattern)]
    # One row per document and text, so repeated rows are not multiplied.
    hits = cut(candidates(trigram_index(docs, rules), rules)) if indexed else None
    frame = docs.select(F.struct("*").alias("row"), *_key(), text_or_empty().alias("text"))
    if hits is not None:
        names = hits.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("hit_key"), F.col("text_hash").alias("hit_hash"), "kinds")
        on = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")) == F.col("hit_key")) & (F.col("text_hash") == F.col("hit_hash"))
        frame = join_small(frame, names, on, "left", row_bytes=120)
    found = []
    for r in rules:
        spans = spans_of(F.col("text"), r)
        if r in indexed:
            spans = F.when(F.array_contains("kinds", r.kind), spans).otherwise(F.array().cast(SPANS))
        found.append(spans.alias(r.kind))
    return frame.select("row", "doc_id", "text", *found)


def ordered(kinds: list[str]) -> Column:
    """Spans of several kinds by start, then in the order of ``kinds``."""
    def ranked(rank: int) -> Column:
        return F.transform(kinds[rank], lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.transform(F.array_sort(F.flatten(F.array(*map(ranked, range(len(kinds)))))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The secrets of each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts hold none. Repeated rows are scanned alike. A null doc_id is a value
    of its own. Spans of one kind never overlap, those of different kinds may; spans that
    start together follow the order of the rules. An empty table gives no rows. Other columns
    are ignored.
    """
    kinds = [r.kind for r in rules]
    # The shape of the row is fixed before the digest, so each expression is evaluated once.
    scanned = with_spans(docs.select("doc_id", "text"), rules).select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.array_join(ordered(list(BASE)), ",").alias("base"), F.array_join(ordered(kinds), ",").alias("spans"))
    return scanned.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with sorted ``spans`` replaced by the names of their kinds.

    A place in a text is found by walking there, so the text is first cut into about as many
    pieces as each has spans.
    """

    def of_covered(covered: Column) -> Column:
        """``covered``: per span how far it and those before it reach."""
        reach = lambda i: F.coalesce(F.get(covered, i - 1), F.lit(0))
        end = F.size(spans)

        def of_size(n: Column) -> Column:
            def piece(i: Column) -> Column:
                begin, stop = reach(i), reach(F.least(i + n, end))

                def marks(own: Column) -> Column:
                    def mark(s: Column, k: Column) -> Column:
                        gap = F.substring(own, reach(i + k) - begin + 1, s["start"] - reach(i + k))
                        return F.when(s["start"] >= reach(i + k), F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise("")

                    return F.array_join(F.transform(F.slice(spans, i + 1, n), mark), "")

                return let(F.substring(text, begin + 1, stop - begin), marks)

            return F.array_join(F.transform(F.sequence(F.lit(0), end - 1, n), piece), "")

        return F.concat(let(F.ceil(F.sqrt(end)).cast("int"), of_size), F.substring(text, reach(end) + 1, F.length(text)))

    return let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), of_covered)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in text replaced by ``[kind]``; overlapping spans become one, named after the first.

    Rows without a secret come through unchanged, null and empty texts too; repeated rows are
    treated alike. Columns may have any names. An empty table gives no rows.
    """
    kinds = [r.kind for r in rules]
    marked = with_spans(docs, rules).withColumn("all_spans", F.array_sort(F.flatten(F.array(*kinds))))
    text = F.when(F.size("all_spans") > 0, let(F.col("all_spans"), lambda s: _masked(F.col("text"), s))).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return marked.select(*columns)

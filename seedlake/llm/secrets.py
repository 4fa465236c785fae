"""Secret scans through a trigram inverted index.

From each rule's pattern a Boolean trigram query is derived: an OR of alternatives, each of which needs all of its trigrams, so
that every match holds all trigrams of one (in lower case). Documents are
posted under the trigrams of these queries, postings are intersected by counting, and only documents that some alternative
leaves over are scanned with that rule's regex; a rule without mandatory trigrams scans every document. DataFrame functions
only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind; pattern; the least length of `group` for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, then rules of public token formats.
BASE = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(CAPITALS, SMALL)


#: Sets of characters of at most SET are spelled out, texts of a stretch up to STRETCH.
SET, STRETCH = 8, 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def least(query: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without alternatives that need more than another one does; an empty alternative holds always."""
    return {x for x in query if not any(y < x for y in query)}


def both(x: set[frozenset[str]], y: set[frozenset[str]]) -> set[frozenset[str]]:
    made = least({a | b for a in x for b in y})
    return made if len(made) <= STRETCH else x  # one of the two is enough


def walk(node) -> tuple[set[str] | None, set[frozenset[str]]]:
    """(all texts that a parsed pattern matches, or None if they are many; what every match needs), in lower case."""
    always = {frozenset()}
    stretch, query = {""}, always

    def flush(q: set[frozenset[str]]) -> set[frozenset[str]]:
        return both(q, least({trigrams(x) for x in stretch}))

    whole = True
    for kind, value in node:
        name, texts, need = str(kind), None, always
        if name == "LITERAL":
            texts = {chr(value).translate(FOLD)}
        elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
            codes = [c for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], min(v[1], v[0] + 64) + 1))]
            texts = {chr(c).translate(FOLD) for c in codes}
            texts = texts if len(texts) <= SET else None
        elif name == "SUBPATTERN":
            texts, need = walk(value[3])
        elif name == "BRANCH":
            parts = [walk(x) for x in value[1]]
            texts = None if any(t is None for t, _ in parts) else set().union(*(t for t, _ in parts))
            need = least(set().union(*(q if t is None else {trigrams(x) for x in t} for t, q in parts)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            own, need = walk(inner)
            if own is not None and high == 1:
                texts = own | ({""} if low == 0 else set())
            elif own is not None and low == high and len(own) ** int(low) <= STRETCH:
                texts = {"".join(x) for x in product(own, repeat=int(low))}
            elif own is not None:
                need = least({trigrams(x) for x in own})
            need = need if low > 0 else always
        elif name == "AT":
            continue
        if texts is None or len(stretch) * len(texts) > STRETCH:
            query = both(flush(query), need if texts is None else least({trigrams(x) for x in texts}))
            stretch, whole = {""}, False
        else:
            stretch = {x + y for x in stretch for y in texts}
    return (stretch, least({trigrams(x) for x in stretch})) if whole else (None, flush(query))


@lru_cache(maxsize=None)
def query_of(pattern: str) -> tuple[tuple[str, ...], ...]:
    """The alternatives of a pattern's trigram query, each with its mandatory trigrams; none: the pattern needs no trigram."""
    query = walk(re._parser.parse(pattern))[1] if "(?i" not in pattern else {frozenset()}
    return () if frozenset() in query else tuple(sorted(tuple(sorted(x)) for x in query))


def queries_of(rules: tuple[Rule, ...]) -> list[tuple[str, int, tuple[str, ...]]]:
    """(kind, alternative, its mandatory trigrams); rules without mandatory trigrams are not here: they scan fully."""
    return [(r.kind, k, need) for r in rules for k, need in enumerate(query_of(r.pattern))]


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind, s, e>> of a rule's matches, leftmost and non-overlapping, in code points, end exclusive.

    What lies between the matches (split) and the matches themselves add up to their places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    parts = F.zip_with(F.zip_with(F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.size(found)), F.transform(found, F.length), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n"))), sizes, lambda x, g: F.struct(x.gap.alias("gap"), x.n.alias("n"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc.at + x.gap
        one = F.struct(F.lit(rule.kind).alias("kind"), s.alias("s"), (s + x.n).alias("e"))
        return F.struct((s + x.n).alias("at"), F.when(x.g >= rule.least, F.concat(acc.out, F.array(one))).otherwise(acc.out).alias("out"))

    made = F.aggregate(parts, start, step, lambda acc: acc.out)
    return F.when(F.regexp(text, F.lit(rule.pattern)), made).otherwise(start.out)


def candidates(docs: DataFrame, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, __kinds): the rules that some alternative of which leaves each document over.

    The index holds a row for each document and query trigram that it contains; an alternative keeps the documents that are
    in all of its lists. Rows are as narrow as a key and a number, and are counted before and after the shuffle.
    """
    queries = queries_of(rules)
    grams = sorted(set().union(*(g for _, _, g in queries)))
    folded = F.translate("text", CAPITALS, SMALL)
    # the text is folded once, as the variable of a lambda
    all_grams = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(i).alias("i")) for i, g in enumerate(grams)])
    held = F.flatten(F.transform(F.array(folded), lambda t: F.filter(all_grams, lambda x: F.contains(t, x.g))))
    postings = docs.select(key, F.explode(held).alias("x")).select(key, F.col("x.i").alias("gram"))
    lists = F.create_map(*[x for i, g in enumerate(grams) for x in (F.lit(i), F.array(*[F.lit(q) for q, (_, _, need) in enumerate(queries) if g in need]))])
    sizes, kinds = F.array(*[F.lit(len(need)) for _, _, need in queries]), F.array(*[F.lit(k) for k, _, _ in queries])
    met = postings.select(key, F.explode(lists[F.col("gram")]).alias("q"), "gram").groupBy(key, "q").agg(F.countDistinct("gram").alias("n"))
    kept = met.where(F.col("n") == F.element_at(sizes, F.col("q") + 1))
    return kept.groupBy(key).agg(F.collect_set(F.element_at(kinds, F.col("q") + 1)).alias("__kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, out: str = "found") -> DataFrame:
    """docs (doc_id, text and any other columns) with `out` (an earlier one is replaced): array<struct<kind, s, e>> sorted by place, then rule order.

    A null text is empty and holds nothing. Rows are joined by a hash of id and text: equal rows have equal candidates, and
    a clash can only add a scan. All rows stay, repeated ones too.
    """
    key = "__row_hash"
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("text", text).withColumn(key, F.xxhash64("doc_id", "text"))
    marked = rows.join(candidates(rows.select(key, "text"), key, rules), key, "left")
    order = F.array(*[F.lit(r.kind) for r in rules])
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    each = [spans(F.col("text"), r) if not query_of(r.pattern) else F.when(F.array_contains("__kinds", F.lit(r.kind)), spans(F.col("text"), r)).otherwise(none) for r in rules]
    ranked = F.transform(F.flatten(F.array(*each)), lambda x: F.struct(x.s.alias("s"), F.array_position(order, x.kind).alias("o"), x.e.alias("e"), x.kind.alias("kind")))
    found = F.transform(F.array_sort(ranked), lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e")))
    return marked.withColumn(out, found).drop(key, "__kinds")


def shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x.kind.isin([r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with every found span of `text` replaced by `<kind>`; overlapping spans become one, named by the first. Null texts stay null."""
    rows = scan(docs.withColumn("__null", F.col("text").isNull()), rules, "__found")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        apart = x.s >= acc.at
        cut = F.array(F.substr("text", acc.at + 1, x.s - acc.at), F.concat(F.lit("<"), x.kind, F.lit(">")))
        return F.struct(F.greatest(acc.at, x.e).alias("at"), F.when(apart, F.concat(acc.out, cut)).otherwise(acc.out).alias("out"))

    text = F.aggregate("__found", start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substr("text", acc.at + 1)))
    return rows.withColumn("text", F.when(F.col("__null"), F.lit(None)).otherwise(F.when(F.size("__found") == 0, F.col("text")).otherwise(text))).drop("__found", "__null")

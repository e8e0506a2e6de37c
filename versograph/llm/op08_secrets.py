"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams of the
text with A-Z lowered: an OR of sets of trigrams that must all occur if the
expression is to match.  An inverted index holds, for each trigram that any query
names, the posting lists of the texts with it (by hash of the text, in blocks, so
that no list grows with the table).  Intersecting the lists of each set, and
uniting the sets of a rule, gives the candidates; only there is the expression
itself tried.  A rule whose expression has no mandatory trigram is tried on every
text.

A match counts if one of its groups is long enough; spans are in code points, the
end exclusive.  Rules that find the same place each report it.

Results: null texts count as empty and hold nothing; repeated rows are scanned
each (texts that are equal share one entry of the index).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.llm.common import DOCUMENT_COLUMNS, joined, table, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java, RE2 and Python; a match counts if group ``part`` has ``least`` characters."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 0


def either(word: str) -> str:
    """A word with each ASCII letter in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
    Rule("github", "gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("google", "AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("slack", "xox[abp]-[0-9A-Za-z-]+", 0, 15),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    Rule("stripe", "sk_live_[0-9A-Za-z]+", 0, 24),
)
BASE = 3
#: Distinct texts in a block of the index, and candidates that are sent to every task rather than joined by a shuffle.
BLOCK_TEXTS, BROADCAST_CANDIDATES = 2000, 500_000
MASK = "[SECRET]"
#: Strings that a part of an expression may stand for, and sets in a query, before the analysis gives up precision.
FEW = 64

Query = frozenset  # of frozensets of trigrams: one of the sets must occur whole
ANYTHING: Query = frozenset([frozenset()])


def _simple(query: Query) -> Query:
    """Without sets that contain another."""
    return frozenset(s for s in query if not any(o < s for o in query))


def _both(a: Query, b: Query) -> Query:
    out = _simple(frozenset(x | y for x, y in product(a, b)))
    return out if len(out) <= FEW else min(a, b, key=len)


def _of_strings(strings: frozenset) -> Query:
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _members(items: list) -> frozenset | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(_lower(chr(arg)))
        elif op is sre.RANGE and arg[1] - arg[0] < FEW:
            out.update(_lower(chr(c)) for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= 5 else None


def _lower(c: str) -> str:
    return c.lower() if c.isascii() else c


def _analyse(parts: list) -> tuple[frozenset | None, Query]:
    """The few strings that a sequence may match, or None; and a query that every match satisfies."""
    query, run, exact = ANYTHING, frozenset([""]), True
    for op, arg in parts:
        strings, own = _element(op, arg)
        if strings is not None and len(strings) * len(run) <= FEW:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        query, exact = _both(_both(query, _of_strings(run)), own), False
        run = strings if strings is not None else frozenset([""])
    return (run if exact else None), _both(query, _of_strings(run))


def _element(op: object, arg: object) -> tuple[frozenset | None, Query]:
    if op is sre.LITERAL:
        return frozenset([_lower(chr(arg))]), ANYTHING
    if op is sre.IN:
        return _members(arg), ANYTHING
    if op is sre.AT:
        return frozenset([""]), ANYTHING
    if op is sre.SUBPATTERN:
        return _analyse(list(arg[3]))
    if op is sre.BRANCH:
        made = [_analyse(list(x)) for x in arg[1]]
        if all(s is not None for s, _ in made):
            union = frozenset().union(*[s for s, _ in made])
            if len(union) <= FEW:
                return union, _of_strings(union)
        return None, _simple(frozenset().union(*[q for _, q in made]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, own = _analyse(list(inner))
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANYTHING
        if low == high and strings is not None and len(strings) ** low <= FEW:
            return frozenset("".join(x) for x in product(strings, repeat=low)), ANYTHING
        return None, own if low else ANYTHING
    return None, ANYTHING


def trigram_query(pattern: str) -> Query:
    """An OR of ANDs of lower-case trigrams that any text with a match satisfies; ANYTHING if there is no mandatory one."""
    _, query = _analyse(list(sre_parser.parse(pattern)))
    return ANYTHING if frozenset() in query else query


def _with_key(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*columns, text.alias("__text"), F.xxhash64(text).alias("__key"))


def inverted_index(texts: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """(trigram, block, keys) of a table with __key and __text."""
    low = texts.select("__key", F.lower("__text").alias("__low"))
    present = F.filter(F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    postings = low.select("__key", F.explode(present).alias("trigram"))
    return postings.groupBy("trigram", F.pmod("__key", F.lit(blocks)).alias("block")).agg(F.collect_set("__key").alias("keys"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, mask): the texts whose trigrams satisfy the query of rule i have bit i; rules without a query are left out."""
    spark = texts.sparkSession
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANYTHING}
    if not queries:
        return None
    sets = [(i, n, t, len(s)) for i, q in queries.items() for n, s in enumerate(sorted(q, key=sorted)) for t in sorted(s)]
    blocks = texts.count() // BLOCK_TEXTS + 1
    index = written(inverted_index(texts, sorted({t for _, _, t, _ in sets}), blocks), "secrets-index")
    wanted = F.broadcast(spark.createDataFrame(sets, "rule int, part int, trigram string, size int"))  # the rules' trigrams
    lists = index.join(wanted, "trigram").groupBy("rule", "part", "block").agg(F.collect_list("keys").alias("lists"), F.first("size").alias("size"))
    whole = lists.where(F.size("lists") == F.col("size"))
    met = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], F.array_intersect)
    found = whole.select("rule", F.explode(met).alias("__key"))
    return found.groupBy("__key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("__mask"))


def matches(text: Column, rule: Rule, number: int) -> Column:
    """The spans (start, k, end) of a rule in a text: leftmost, not overlapping, failing ones dropped."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    pairs = F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b"), (F.length(F.regexp_extract(b, rule.pattern, rule.part)) >= rule.least).alias("good")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,k:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["a"]
        span = F.struct(start.alias("start"), F.lit(number).alias("k"), (start + x["b"]).alias("end"))
        return F.struct((start + x["b"]).alias("at"), F.when(x["good"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def with_spans(docs: DataFrame, columns: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``columns``, the text as __text, and all spans as __spans, in the order of start, rule and end."""
    rows = _with_key(docs, *columns)
    masks = candidates(_with_key(docs), rules)
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    if masks is None:
        rows = rows.withColumn("__mask", F.lit(0).cast("long"))
    else:
        masks = written(masks, "secrets-candidates")
        if masks.count() <= BROADCAST_CANDIDATES:
            rows = rows.join(F.broadcast(masks), "__key", "left")
        else:  # texts of which there are very many copies are told apart
            keys = _with_key(docs).select("__key")
            copies = keys.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
            rows = joined(rows, written(masks.join(copies, "__key"), "secrets-candidates"), ["__key"], keys.count(), "left")
    each = []
    for i, r in enumerate(rules):
        if trigram_query(r.pattern) == ANYTHING:
            least = r.pattern[:-1] + f"{{{r.least},}}" if r.part == 0 and r.least and r.pattern.endswith("]+") and r.pattern.count("[") == 1 else r.pattern
            likely = F.col("__text").rlike(least)
        else:
            likely = F.col("__mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        each.append(F.when(likely, matches(F.col("__text"), r, i)).otherwise(none))
    return rows.select(*columns, "__text", F.array_sort(F.concat(*each)).alias("__spans"))


def _shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """doc_id, the counts of the first ``base`` rules, the digest of their spans, and all spans as text."""
    rows = with_spans(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), ("doc_id",), rules)
    of = F.filter("__spans", lambda s: s["k"] < base)

    def count(k: int) -> Column:
        return F.size(F.filter("__spans", lambda s: s["k"] == k)).cast("long")

    counts = [count(i).alias(f"n_{rules[i].kind}") for i in range(base)]
    return rows.select("doc_id", *counts, F.sha2(_shown(of, rules), 256).alias("base_sha256"), _shown(F.col("__spans"), rules).alias("spans"))


def redacted_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret masked (overlapping spans as one), and n_chars of the texts so changed."""
    rows = with_spans(docs, DOCUMENT_COLUMNS, rules)
    text = F.col("__text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.length(text)))

    some = F.size("__spans") > 0
    made = rows.withColumn("__new", F.when(some, F.aggregate("__spans", zero, step, finish)))
    out = {"text": F.when(some, F.col("__new")).otherwise(F.col("text")), "n_chars": F.when(some, F.length("__new").cast("long")).otherwise(F.col("n_chars"))}
    return made.select(*[out[c].alias(c) if c in out else F.col(c) for c in DOCUMENT_COLUMNS])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = []
    for i, r in enumerate(RULES):
        p = quote(r.pattern)
        each.append(f"""SELECT rid, {i} AS k, {quote(r.kind)} AS kind, m[i] AS m,
          (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
        FROM (SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT rid, regexp_extract_all(t, {p}, 0) AS m, string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p})))
        WHERE length(regexp_extract(m[i], {p}, {r.part})) >= {r.least}""")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({" UNION ALL ".join(each)}),
    a AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      coalesce(string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) FILTER (k < {BASE}), '') AS base,
      string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


OP8_SQL = _oracle()

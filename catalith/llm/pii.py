"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four kinds are matched by fixed patterns in every whole text; the valid matches
are the base and the seeds. Seeds induce lexical patterns: the word before and
the word after, for each kind. Identifier-like tokens that overlap no base match
are candidates. An instance is a kind and a normalised value, wherever it stands:
all its places, in all texts, bring their patterns to it. Patterns and instances
form a bipartite graph of distinct edges that is scored in rounds: a pattern by
the confidence of the instances it stands beside (shrunk by its candidates and a
prior), an instance by noisy-or of its patterns. Instances that end above
`accept`, through patterns with enough seeds, are taken; they then induce
patterns as seeds do, and the graph is built and scored anew until nothing is
added. A candidate whose value is that of a seed is taken too. Spans are added at
the places of taken values that stand beside a pattern of the graph or, with
`everywhere`, at all their places.

Positions come from the lengths of what lies between matches, summed by a
window over a text's matches. Patterns use possessive repeats, and words are
looked for from the near end, so that neither time nor stack grows with the
square of a long run. No length of a token or a context is limited.

Defined results: null texts are empty; texts without matches have zero counts,
an empty span list and its digest; a null doc_id is kept; repeated rows give
repeated result rows, but count once as seeds; extra columns are ignored; an
empty table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.llm.common import cut, load

KINDS = ("email", "ip", "card", "phone")
#: The same languages as the plain forms email, ip, card and phone; see the module's note on repeats.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)\S*[0-9@]\S*"
#: Shapes of candidates, once punctuation is stripped from their ends.
SHAPES = {
    "email": r"^[^\s@,;:]+@[^\s@,;:]+\.[^\s@,;:]+$",
    "ip": r"^[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[-.]?[0-9]){11,18}$",
    "phone": r"^\(?[0-9](?:[().-]?[0-9]){8,10}$",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
NEXT_WORD = r"^[\s\p{Punct}]*+([^\s\p{Punct}]++)"


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _contexts(between: Column, found: Column) -> Column:
    """For each match: value, characters since the match before, and the words around it."""
    n = F.size(found)
    word = lambda x: F.lower(F.regexp_extract(x, NEXT_WORD, 1))
    gaps = F.transform(between, lambda b: F.struct(F.length(b).alias("gap"), F.reverse(word(F.reverse(b))).alias("last"), word(b).alias("first")))
    one = F.zip_with(found, F.slice(gaps, 1, n), lambda v, g: F.struct(v.alias("value"), g["gap"].alias("gap"), g["last"].alias("before")))
    return F.zip_with(one, F.slice(gaps, 2, n), lambda m, g: F.struct(m["value"].alias("value"), m["gap"].alias("gap"), m["before"].alias("before"), g["first"].alias("after")))


def _base_of(kind: str):
    return lambda x: x["base"] & (x["kind"] == kind)


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, digest, kind ("token" for candidates), start, end, value, before, after:
    every match of every pattern in every distinct text of an id. A row holds the pieces
    of one pattern at a time."""
    text, kind = F.col("t"), F.col("kind")
    patterns = {**BASE, "token": TOKEN}
    guards = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+"), "token": text.rlike("[0-9@]")}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("digest", F.xxhash64("t"))
    each = texts.select("doc_id", "digest", "t", F.explode(F.array_compact(F.array(*[F.when(guards[k], F.lit(k)) for k in patterns]))).alias("kind"))
    by_kind = lambda f: F.coalesce(*[F.when(kind == k, f(p)) for k, p in patterns.items()])
    split = each.select("doc_id", "digest", "kind", by_kind(lambda p: F.split("t", p, -1)).alias("between"), by_kind(lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))).alias("found"))
    rows = split.select("doc_id", "digest", "kind", F.posexplode(_contexts(F.col("between"), F.col("found"))).alias("i", "m")).select("doc_id", "digest", "kind", "i", "m.*")
    rows = rows.dropDuplicates(["doc_id", "digest", "kind", "i"])
    along = W.partitionBy("doc_id", "digest", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("value")
    end = F.sum(F.col("gap") + size).over(along)
    return rows.select("doc_id", "digest", "kind", (end - size).alias("start"), end.alias("end"), "value", "before", "after")


def candidates(tokens: DataFrame) -> DataFrame:
    """Tokens stripped of punctuation at their ends, with the kind whose shape they have."""
    head = F.regexp_replace("value", r"^[^A-Za-z0-9(]++", "")
    core = F.reverse(F.regexp_replace(F.reverse(head), r"^[^A-Za-z0-9]++", ""))
    kind = F.coalesce(*[F.when(F.col("core").rlike(SHAPES[k]), F.lit(k)) for k in KINDS])
    start = F.col("start") + F.length("value") - F.length(head)
    cut_ = tokens.select("doc_id", "digest", start.alias("start"), core.alias("core"), "before", "after").withColumn("kind", kind).where("kind IS NOT NULL")
    return cut_.select("doc_id", "digest", "kind", "start", (F.col("start") + F.length("core")).alias("end"), F.col("core").alias("value"), "before", "after")


def places(found: DataFrame) -> DataFrame:
    """Base matches and the candidates that overlap none, as doc_id, digest, kind, start, end,
    value (normalised), before, after, base. One pass along each text and one back; both
    keep a running end, so that time follows the matches of a text and not their square."""
    base = found.where("kind <> 'token'").withColumn("base", F.lit(True))
    both = base.unionByName(candidates(found.where("kind = 'token'")).withColumn("base", F.lit(False)))
    along = W.partitionBy("doc_id", "digest").orderBy("start", F.desc("base"))
    before = F.max(F.when(F.col("base"), F.col("end"))).over(along.rowsBetween(W.unboundedPreceding, 0))
    back = W.partitionBy("doc_id", "digest").orderBy(F.desc("start"), "base")
    after = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(W.unboundedPreceding, -1))
    value = F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value"))
    apart = F.col("base") | ((F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.col("_after").isNull() | (F.col("_after") >= F.col("end"))))
    return both.withColumns({"_before": before, "_after": after}).where(apart).drop("_before", "_after").withColumn("value", value)


def discover(found: DataFrame, rounds: int = 3, prior: float = 3.0, accept: float = 0.9, least_seeds: int = 5, everywhere: bool = False) -> DataFrame:
    """The places of `found` (see places) whose values the scored graph takes: doc_id, digest,
    kind, start, end. What is taken induces patterns as seeds do, until nothing is added."""
    spot = ["doc_id", "digest", "kind", "start", "end"]
    instance, edge = ["kind", "value"], ["kind", "pattern"]
    sides = F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(mark), F.col(c))) for c, mark in (("before", "<"), ("after", ">"))]))
    beside = found.select(*spot, "value", "base", sides.alias("sides"))
    # A place without words around it still tells whether its value is a seed.
    named = beside.select(*instance, "base", F.explode_outer("sides").alias("pattern"))
    seen = cut(named.groupBy(*instance, "pattern").agg(F.max("base").alias("base")))
    vouched = seen.where("base").select(*instance).distinct().withColumn("seed", F.lit(True))
    edges = seen.join(vouched, instance, "left").select(*instance, "pattern", F.coalesce("seed", F.lit(False)).alias("seed"))
    taken = None
    while True:
        known = edges.where("pattern IS NOT NULL")
        # A pattern matters only where it stands beside a candidate; seeds are summed for it once.
        sums = known.groupBy(*edge).agg(F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("open"))
        patterns = sums.where((F.col("open") > 0) & (F.col("seeds") >= least_seeds))
        graph = cut(known.where("NOT seed").drop("seed").join(patterns, edge))
        scored = graph.withColumn("confidence", F.lit(0.0))
        for _ in range(rounds):
            mass = scored.groupBy(*edge).agg(F.sum("confidence").alias("mass"))
            weight = (F.col("seeds") + F.col("mass")) / (F.col("seeds") + F.col("open") + prior)
            lit_up = graph.join(mass, edge).withColumn("doubt", F.log1p(-F.least(weight, F.lit(0.999))))
            level = lit_up.groupBy(*instance).agg((1 - F.exp(F.sum("doubt"))).alias("confidence"))
            scored = graph.join(level, instance)
        new = cut(level.where(F.col("confidence") >= accept).select(*instance))
        if new.isEmpty():
            break
        of_new = graph.join(new, instance, "left_semi").select(*instance, "pattern")
        taken = of_new if taken is None else taken.unionByName(of_new)
        marked = edges.join(new.withColumn("_new", F.lit(True)), instance, "left")
        edges = cut(marked.select(*instance, "pattern", (F.col("seed") | F.coalesce("_new", F.lit(False))).alias("seed")))
    open_places = beside.where("NOT base")
    if everywhere:
        final = edges.where("seed").select(*instance).distinct()
        return open_places.join(final, instance, "left_semi").select(spot)
    if taken is None:
        return open_places.select(spot).limit(0)
    return open_places.select(*spot, "value", F.explode("sides").alias("pattern")).join(taken, [*instance, "pattern"], "left_semi").select(spot).distinct()


def pii(docs: DataFrame, rounds: int = 3, accept: float = 0.9, everywhere: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone (base counts),
    base_sha256, spans (all), n_added."""
    found = cut(places(matches(docs).where((F.col("kind") == "token") | _valid(F.col("kind"), F.col("value")))))
    columns = ["doc_id", "digest", "kind", "start", "end"]
    added = discover(found, rounds, accept=accept, everywhere=everywhere)
    spans = found.where("base").select(*columns, F.lit(True).alias("base")).unionByName(added.select(*columns, F.lit(False).alias("base")))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    by_doc = spans.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "end", "kind", "base"))).alias("s"))
    by_doc = by_doc.select(
        F.col("doc_id").alias("of"), "digest",
        *[F.size(F.filter("s", _base_of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written(F.filter("s", lambda x: x["base"])), 256).alias("base_sha256"),
        written(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_added"),
    )
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("d"))
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("d") == F.col("digest")), "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0).cast("long")).alias("n_added"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pii(load(spark, sf_dir, "documents"), everywhere=True)

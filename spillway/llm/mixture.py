"""Mixing sources to target weights (operator 5), in DataFrame operations only.

The leaves of a tree domain > language > source hold tokens.  A budget of tokens goes down
the tree: a node divides its own among its children by weight.  A child that cannot use its
part (all of its tokens in ``epochs`` passes are fewer) takes what it can; the rest goes to
its siblings by weight, and only what a whole family cannot use was never given to the
family in the first place, so shortages meet siblings before ancestors' siblings.  A leaf
spends its budget on epochs: whole passes over its documents, then the documents of the
next pass whose tokens in front of them, in that pass's seeded order, are below what is
left.  Every pass has an order of its own.

All amounts are whole numbers, so the result does not depend on the order of sums; tokens
that remain when a budget is divided go one each to the first children that have room.
Only counts by leaf and by leaf and bucket of the order meet in windows.  The order is
searched digit by digit: of each leaf, the one bucket in which the budget ends is dealt into
buckets again, until about ``SHORT`` rows of a leaf are left for the document window.

Cases: null source or language is a value of its own ('?'); a null or blank text has no
tokens and is taken with any whole pass, or where the budget is not spent yet at its place
in the order; a very long text counts all of its words and may end its leaf's budget beyond
the mark, as it is not cut; each row is a document of its own, with or without an id of its
own; rows that share id and text in a leaf (a unit) stand together in the order, and as many of
them are taken as there is budget for: of those that differ in other columns the ones with
the smallest hashes; a node of weight 0 gets nothing, and what lies below it is no capacity of its
parents; an empty table gives no rows; extra columns travel with their row in ``mix`` but not
in the result of the query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, store, table
from .components import join_by_key

SEED = 17
EPOCHS = 2
#: Share of all tokens that the mixture has.
SHARE_PERCENT = 70
#: Hex digits of the seeded order that make a bucket, and rows of a leaf that need no more buckets.
BUCKET, SHORT = 2, 512
NONE = "?"
#: Leaves up to this many are broadcast.
SMALL = 50_000
#: Weights of production: domains, languages and sources that are not named weigh DEFAULT.
DEFAULT = 10
DOMAIN_WEIGHTS = {"d0": 16, "d1": 10, "d2": 8, "d3": 6}
LANG_WEIGHTS = {"en": 12, "de": 8, "fr": 8, "es": 6}
SOURCE_WEIGHTS = {"src0": 30}
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """d0 to d3 by the number that ends a source's name; '?' without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.pmod(number.cast("long"), F.lit(4)).cast("string"))).otherwise(NONE)


def _weight(column: Column, weights: dict[str, int]) -> Column:
    chosen = F.lit(DEFAULT)
    for name, w in weights.items():
        chosen = F.when(column == name, F.lit(w)).otherwise(chosen)
    return chosen.cast("long")


def _divide(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``given``: ``budget`` of each parent over its children by ``weight``, at most ``capacity`` each.

    In rising order of capacity for its weight, a child is full if its part of what is left
    reaches its capacity; the first that is not leaves the rest to be divided by weight.  The
    parts are rounded down; what remains goes one token each to the first of these children.
    """
    key = F.struct(F.col("capacity") / F.col("weight"), F.col(child))
    family = Window.partitionBy(*parent)
    before = family.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    kids = children.where("weight > 0").withColumns(
        {
            "key": key,
            "rest": (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast("decimal(38,0)"),
            "weights": F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    open_ = F.when(F.expr("cast(capacity as decimal(20,0)) * weights > rest * weight"), F.struct("key", "rest", "weights"))
    kids = kids.withColumn("open", F.min(open_).over(family))
    part = F.expr("cast(open.rest as long) * weight div open.weights")
    full = F.col("open").isNull() | (F.col("key") < F.col("open.key"))
    kids = kids.withColumn("part", F.when(~full, part))
    place = F.row_number().over(family.orderBy(key)) - F.count_if(full).over(family)
    left = F.col("open.rest").cast("long") - F.sum("part").over(family)
    extra = F.when(place <= left, 1).otherwise(0)
    return kids.withColumn("given", F.when(full, F.col("capacity")).otherwise(F.col("part") + extra)).drop("key", "rest", "weights", "open", "part")


def budgets(leaves: DataFrame, budget: Column, domains=DOMAIN_WEIGHTS, langs=LANG_WEIGHTS, sources=SOURCE_WEIGHTS) -> DataFrame:
    """(domain, language, origin, tokens, given) from leaves with ``capacity`` and ``tokens``."""
    low = leaves.withColumn("weight", _weight(F.col("origin"), sources))
    kin = low.where("weight > 0").groupBy("domain", "language").agg(F.sum("capacity").cast("long").alias("capacity"))
    kin = kin.withColumn("weight", _weight(F.col("language"), langs))
    top = kin.where("weight > 0").groupBy("domain").agg(F.sum("capacity").cast("long").alias("capacity"))
    top = top.withColumns({"root": F.lit(0), "budget": budget, "weight": _weight(F.col("domain"), domains)})
    top = _divide(top, ["root"], "domain").select("domain", F.col("given").alias("budget"))
    kin = _divide(kin.join(top, "domain"), ["domain"], "language")
    low = low.join(kin.select("domain", "language", F.col("given").alias("budget")), ["domain", "language"])
    return _divide(low, ["domain", "language"], "origin").select("domain", "language", "origin", "tokens", "given")


LEAF = ["domain", "language", "origin"]


def _keyed(docs: DataFrame, id: str, text: str, lang: str, source: str, **more: Column) -> DataFrame:
    origin, language = (F.coalesce(F.col(c), F.lit(NONE)) for c in (source, lang))
    own = (F.coalesce(F.col(id).cast("string"), F.lit(NONE)), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))), language, origin)
    columns = {"unit": F.md5(F.concat_ws("\x1f", *own)), "id": F.col(id), "domain": domain_of(origin), "language": language, "origin": origin}
    return docs.select(*(c.alias(name) for name, c in (more | columns).items()))


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(n_tokens, unit, id, domain, language, origin) of each row, written once: all that the choice needs."""
    return store(_keyed(docs, id, text, lang, source, n_tokens=_words(text)))


def choose(rows: DataFrame, share: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED, bucket: int = BUCKET, **weights: dict[str, int]) -> DataFrame:
    """(unit, n, takes): of each unit with so many ``measured`` rows the passes (from 0) that take it, as array<struct<epoch, k>>, and how many of its rows."""
    light = rows.groupBy("unit", *LEAF).agg(F.max("n_tokens").alias("each"), F.count("*").alias("n"))
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").cast("long").alias("tokens"), F.count("*").alias("n")).withColumn("capacity", F.col("tokens") * epochs)
    leaves = cut(leaves)
    total, largest, n_leaves = leaves.agg(F.sum("tokens"), F.max("n"), F.count("*")).first()
    plan = cut(budgets(leaves, F.lit((total or 0) * share // 100).cast("long"), **weights))
    # passes of each leaf: whole ones, and one that ends with the budget
    passes = plan.select(*LEAF, "given", "tokens", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    passes = passes.withColumn("part", F.least(F.col("given") - F.col("epoch") * F.col("tokens"), F.col("tokens"))).where("part > 0")
    if n_leaves <= SMALL:  # leaves are the meetings of sources and languages
        passes = F.broadcast(passes)
    whole = passes.where("part = tokens").select(*LEAF, "epoch")
    rest = passes.where("part < tokens").select(*LEAF, "epoch", "part")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("unit")))
    # units whose place is not settled: those in the bucket in which the budget ends, with the tokens ahead of that bucket
    open_ = light.join(rest, LEAF).withColumns({"place": place, "ahead": F.lit(0).cast("long")})
    all_of = ["unit", "n", "epoch", F.col("n").alias("k")]
    taken = [light.join(whole, LEAF).select(*all_of)]
    run = Window.partitionBy(*LEAF, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at, rows_left = 0, largest or 0
    while rows_left > SHORT and at + bucket <= 32:
        open_ = open_.withColumn("bucket", F.substring("place", at + 1, bucket))
        sums = open_.groupBy(*LEAF, "epoch", "part", "ahead", "bucket").agg(F.sum(F.col("each") * F.col("n")).cast("long").alias("in_bucket"))
        sums = sums.withColumn("front", F.col("ahead") + F.coalesce(F.sum("in_bucket").over(run), F.lit(0)).cast("long")).where("front < part")
        sums = sums.select(*LEAF, "epoch", "bucket", "front", (F.col("front") + F.col("in_bucket") < F.col("part")).alias("whole"))
        if n_leaves << 4 * bucket <= SMALL:  # of each leaf up to 16 ** bucket rows
            sums = F.broadcast(sums)
        met = open_.drop("ahead").join(sums, [*LEAF, "epoch", "bucket"])
        taken.append(met.where("whole").select(*all_of))
        open_ = store(met.where("not whole").select("unit", "n", *LEAF, "epoch", "part", "each", "place", F.col("front").alias("ahead")))
        at, rows_left = at + bucket, rows_left >> 4 * bucket
    inner = Window.partitionBy(*LEAF, "epoch").orderBy("place", "unit").rowsBetween(Window.unboundedPreceding, -1)
    last = open_.withColumn("front", F.col("ahead") + F.coalesce(F.sum(F.col("each") * F.col("n")).over(inner), F.lit(0))).where("front < part")
    # rows of a unit follow each other: each that begins below the mark is taken
    k = F.when(F.col("each") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.expr("(part - front + each - 1) div nullif(each, 0)")))
    taken.append(last.select("unit", "n", "epoch", k.cast("long").alias("k")))
    return store(reduce(DataFrame.union, taken).groupBy("unit").agg(F.max("n").alias("n"), F.collect_list(F.struct("epoch", "k")).alias("takes")))


def _meet(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The columns of ``rows`` and epoch for each pass that takes a row.

    Units taken whole meet their rows by ``join_by_key``, so a unit of very many rows is not
    dealt.  Of a unit of which a pass takes a part (one at most of each leaf and pass) equal
    rows are counted before they are dealt, and come out as often as they are taken.
    """
    columns = rows.columns
    n_rows = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    full = chosen.select("unit", "n", F.transform(F.filter("takes", lambda t: t["k"] == F.col("n")), lambda t: t["epoch"]).alias("epochs"))
    out = join_by_key(rows, full.where(F.size("epochs") > 0), "unit", n_rows).select(*columns, F.explode("epochs").alias("epoch"))
    parts = cut(chosen.select("unit", "n", F.explode("takes").alias("t")).where("t.k < n").select("unit", "t.epoch", "t.k"))
    if parts.isEmpty():
        return out
    some = parts.select("unit").distinct()
    some = F.broadcast(some) if some.count() <= SMALL else some
    hashed = rows.join(some, "unit").withColumn("_hash", F.xxhash64(*columns))
    equal = hashed.groupBy("unit", "_hash").agg(F.count("*").alias("_n"), F.first(F.struct(*columns)).alias("_row"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("unit").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of = equal.withColumn("_ahead", ahead).join(parts, "unit").withColumn("_take", F.least(F.col("_n"), F.col("k") - F.col("_ahead"))).where("_take > 0")
    copies = of.select("_row", "epoch", F.explode(F.sequence(F.lit(1), F.col("_take"))))
    return out.unionByName(copies.select(*(F.col("_row")[c].alias(c) for c in columns), "epoch"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in the mixture as column ``row`` with n_tokens, unit, id, domain, language, origin and epoch; options: those of ``choose``."""
    chosen = choose(measured(docs, id, text, lang, source), **options)
    return _meet(_keyed(docs, id, text, lang, source, row=F.struct("*"), n_tokens=_words(text)), chosen)


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang_key, source_key, epoch, n_tokens) of every document and pass in the mixture."""
    rows = measured(table(spark, sf_dir, "documents"))
    return _meet(rows, choose(rows)).select(
        F.col("id").alias("doc_id"), "domain", F.col("language").alias("lang_key"), F.col("origin").alias("source_key"), "epoch", "n_tokens"
    )


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {DEFAULT} END"


def _divide_sql(name: str, children: str, parent: str, child: str) -> str:
    """DuckDB SQL of _divide."""
    over = f"OVER (PARTITION BY {parent} ORDER BY capacity / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_a AS (
  SELECT *, budget - coalesce(sum(capacity) {over}, 0) AS rest,
         sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) {over}, 0) AS weights,
         row_number() OVER (PARTITION BY {parent} ORDER BY capacity / weight, {child}) AS place
  FROM ({children}) WHERE weight > 0
), {name}_b AS (
  SELECT *, min(CASE WHEN capacity * weights > rest * weight THEN place END) OVER (PARTITION BY {parent}) AS opened FROM {name}_a
), {name}_c AS (
  SELECT b.*, max(CASE WHEN place = opened THEN rest END) OVER (PARTITION BY {parent}) AS open_rest,
         max(CASE WHEN place = opened THEN weights END) OVER (PARTITION BY {parent}) AS open_weights
  FROM {name}_b b
), {name}_d AS (
  SELECT c.*, CASE WHEN place >= opened THEN open_rest * weight // open_weights END AS part FROM {name}_c c
), {name} AS (
  SELECT d.* EXCLUDE (rest, weights, place, opened, open_rest, open_weights, part),
         CAST(CASE WHEN opened IS NULL OR place < opened THEN capacity
              ELSE part + CASE WHEN place - opened < open_rest - sum(part) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END END AS BIGINT) AS given
  FROM {name}_d d
)"""


#: DuckDB SQL for the rows of op5_mixture.
SQL = rf"""
WITH keyed AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens,
         CASE WHEN regexp_extract(coalesce(source, '?'), '([0-9]{{1,9}})$', 1) <> ''
              THEN 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) ELSE '?' END AS domain,
         coalesce(lang, '?') AS lang_key, coalesce(source, '?') AS source_key,
         md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), '?'), md5(coalesce(text, '')), coalesce(lang, '?'), coalesce(source, '?'))) AS unit
  FROM documents
), leaves AS (
  SELECT domain, lang_key, source_key, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {EPOCHS} AS BIGINT) AS capacity
  FROM keyed GROUP BY ALL
), weighed AS (
  SELECT *, {_case('domain', DOMAIN_WEIGHTS)} AS w1, {_case('lang_key', LANG_WEIGHTS)} AS w2, {_case('source_key', SOURCE_WEIGHTS)} AS w3 FROM leaves
), {_divide_sql("tops", f"SELECT 0 AS root, domain, CAST(sum(capacity) AS BIGINT) AS capacity, (SELECT CAST(sum(n_tokens) AS BIGINT) * {SHARE_PERCENT} // 100 FROM keyed) AS budget, any_value(w1) AS weight FROM weighed WHERE w2 > 0 AND w3 > 0 GROUP BY domain", "root", "domain")},
{_divide_sql("kin", "SELECT l.domain, lang_key, CAST(sum(l.capacity) AS BIGINT) AS capacity, any_value(t.given) AS budget, any_value(w2) AS weight FROM weighed l JOIN tops t USING (domain) WHERE w3 > 0 GROUP BY l.domain, lang_key", "domain", "lang_key")},
{_divide_sql("low", "SELECT l.*, k.given AS budget, w3 AS weight FROM weighed l JOIN kin k USING (domain, lang_key)", "domain, lang_key", "source_key")},
passes AS (
  SELECT domain, lang_key, source_key, CAST(e AS INTEGER) AS epoch, least(given - e * tokens, tokens) AS part
  FROM low, unnest(range({EPOCHS})) AS t(e) WHERE given - e * tokens > 0
), placed AS (
  SELECT k.*, epoch, part, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang_key, source_key, epoch
         ORDER BY md5('{SEED}:' || epoch || ':' || unit) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN passes USING (domain, lang_key, source_key)
)
SELECT doc_id, domain, lang_key, source_key, epoch, n_tokens FROM placed JOIN low USING (domain, lang_key, source_key)
WHERE ahead < part OR part = tokens
"""

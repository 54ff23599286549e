"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget is passed down a tree of levels (domain, language, source). Among the children of a node the
budget is filled in proportion to their weights up to what their subtrees can supply (tokens times max_epochs).
What a child cannot supply goes to its siblings; only what a whole subtree cannot supply reaches the siblings
of its ancestors. Each leaf then takes a prefix of its token stream: whole epochs, and of the last epoch the
documents in the order of a seeded hash up to the leaf's budget, the last document in part.

Nothing is ordered in one task: hash order is cut into buckets, the tokens of each bucket are summed, and only
the one bucket of each leaf in which its budget ends is sorted.

Defined cases: null labels are the label "(none)"; texts that are null, empty or blank have no tokens and are
never drawn; equal rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, written

NONE = "(none)"
#: A token is a longest run of characters other than these.
BLANK = " \\t\\r\\n"
#: Hex digits of the seeded hash that make a bucket: 4096 buckets a leaf.
DIGITS = 3

#: Production parameters of the query. Domains group sources; labels that are not named weigh DEFAULT_WEIGHT.
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4"), "books": ("src5", "src6", "src7", "src8", "src9"), "code": ("src10", "src11", "src12", "src13", "src14")}
OTHER_DOMAIN = "misc"
WEIGHTS = [{"web": 20, "books": 40, "code": 30, "misc": 10}, {"en": 50, "de": 20, "fr": 20, "es": 10}, {"src0": 5, "src5": 20, "src10": 20}]
DEFAULT_WEIGHT = 10
BUDGET_PERCENT, MAX_EPOCHS, SEED = 60, 2, "mix-1"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def domain(source: Column) -> Column:
    case = None
    for name, members in DOMAINS.items():
        case = (F if case is None else case).when(source.isin(*members), name)
    return case.otherwise(OTHER_DOMAIN)


def _weight(name: Column, weights: dict[str, int]) -> Column:
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    case = F.lit(DEFAULT_WEIGHT)
    for k, w in weights.items():
        case = F.when(name == k, w).otherwise(case)
    return case.cast("decimal(18,0)")


def _filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """alloc for each child, given weight, cap and the parent's budget, in whole tokens that add up to the budget."""
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rows = children.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0).cast("decimal(20,0)")))
    rows = rows.withColumn("b", F.least("budget", F.sum("cap").over(of)).cast("decimal(20,0)"))
    rows = rows.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(0.0))
    before = of.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(20,0)")
    rows = rows.withColumns({"w_left": (F.sum("weight").over(of) - F.coalesce(F.sum("weight").over(before), zero)).cast("decimal(18,0)"), "b_left": (F.col("b") - F.coalesce(F.sum("cap").over(before), zero)).cast("decimal(20,0)")})
    rows = rows.withColumn("full", F.expr("cap * w_left <= weight * b_left"))
    rows = rows.withColumns({"w_open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(zero)).over(of).cast("decimal(18,0)"), "b_open": (F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(of)).cast("decimal(20,0)")})
    rows = rows.withColumns({"share": F.expr("if(full, cap, cast((b_open * weight) div w_open as decimal(20,0)))"), "rest": F.expr("if(full, cast(-1 as decimal(38,0)), cast((b_open * weight) % w_open as decimal(38,0)))")})
    rows = rows.withColumn("left", F.col("b") - F.sum("share").over(of)).withColumn("rank", F.row_number().over(of.orderBy(F.col("rest").desc(), F.col(name))))
    return rows.withColumn("alloc", (F.col("share") + F.when(~F.col("full") & (F.col("rank") <= F.col("left")), 1).otherwise(0)).cast("decimal(20,0)"))


def allocate(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """Each leaf's tokens and alloc. leaves: the levels and tokens. budget: an expression over total, all tokens."""
    caps = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("decimal(20,0)"))
    above = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).select(budget.cast("decimal(20,0)").alias("budget"))
    for i, level in enumerate(levels):
        nodes = caps.groupBy(*levels[: i + 1]).agg(F.sum("cap").cast("decimal(20,0)").alias("cap")).withColumn("weight", _weight(F.col(level), weights[i]))
        nodes = nodes.join(above, levels[:i]) if i else nodes.crossJoin(F.broadcast(above))  # one row: the whole budget
        above = _filled(nodes, levels[:i], level).select(*levels[: i + 1], F.col("alloc").alias("budget"))
    return leaves.join(above, levels).select(*levels, "tokens", F.col("budget").cast("long").alias("alloc"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget: Column, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """What each leaf draws: a row for each document and epoch drawn, with n_tokens and take_tokens.

    Besides the id, the levels, epoch, n_tokens and take_tokens it has the columns named in carry. Labels of
    the levels must be strings.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    carry = carry or []
    base = docs.select(F.col(id_column).alias("_id"), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(names, levels.values(), strict=True)), tokens(F.col(text_column)).alias("_n"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    slim = written(base.select("_id", *names, "_n").where("_n > 0"), "mix-tokens")
    leaves = slim.groupBy(*names).agg(F.sum("_n").alias("tokens"))
    alloc = written(allocate(leaves, names, weights, budget, max_epochs).selectExpr(*names, "alloc div tokens as _full", "alloc % tokens as _rem"), "mix-budgets")

    def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
        rows = lookup(rows, plan, names)
        rows = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("_full").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(NONE))).cast("binary")))
        return rows.withColumn("_bucket", F.substring("_h", 1, DIGITS))

    sums = placed(slim, alloc.where("_rem > 0")).groupBy(*names, "_bucket", "_rem").agg(F.sum("_n").alias("in_bucket"))
    up_to = F.sum("in_bucket").over(Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("_to", up_to).where("_to >= _rem and _to - in_bucket < _rem").select(*names, F.col("_bucket").alias("_end"), F.expr("_to - in_bucket").alias("_before"))
    plan = written(alloc.join(ends, names, "left"), "mix-plan")

    rows = placed(base.where("_n > 0") if carry else slim, plan)
    epochs = F.expr("_full + if(_end is not null and _bucket < _end, 1, 0)")
    whole = rows.where(epochs > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1))).withColumn("_take", F.col("_n"))
    in_order = Window.partitionBy(*names).orderBy("_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("_bucket = _end").withColumn("_start", F.col("_before") + F.sum("_n").over(in_order) - F.col("_n")).where("_start < _rem")
    last = last.withColumn("_epoch", F.col("_full")).withColumn("_take", F.least(F.col("_n"), F.col("_rem") - F.col("_start"))).drop("_start")
    out = whole.unionByName(last)
    return out.select(F.col("_id").alias(id_column), *(F.col(n).alias(k) for n, k in zip(names, levels, strict=True)), F.col("_epoch").alias("epoch"), F.col("_n").alias("n_tokens"), F.col("_take").alias("take_tokens"), *(F.col(f"_c_{c}").alias(c) for c in carry if c != id_column and c not in levels))


def prefix(text: Column, take: Column) -> Column:
    """The text up to the end of its take-th token."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{BLANK}]*[^{BLANK}]+"), F.lit(0)), F.lit(1), take.cast("int")), "")


def budget() -> Column:
    return F.expr(f"total * {BUDGET_PERCENT} div 100")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    levels = {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, levels, WEIGHTS, budget())


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of query()."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def weight(level: str, weights: dict[str, int]) -> str:
        return "case " + " ".join(f"when {level} = {quoted(k)} then {w}" for k, w in weights.items()) + f" else {DEFAULT_WEIGHT} end"

    case = "case " + " ".join(f"when source in ({', '.join(map(quoted, m))}) then {quoted(k)}" for k, m in DOMAINS.items()) + f" else {quoted(OTHER_DOMAIN)} end"
    levels, out = ["domain", "lang", "source"], []
    out.append(f"toks as (select doc_id, coalesce({case}, {quoted(NONE)}) as t_domain, coalesce(lang, {quoted(NONE)}) as t_lang, coalesce(source, {quoted(NONE)}) as t_source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::bigint as n_tokens from {documents})")
    out.append("leaves as (select t_domain as domain, t_lang as lang, t_source as source, sum(n_tokens)::hugeint as tokens from toks where n_tokens > 0 group by all)")
    out.append(f"b0 as (select (coalesce(sum(tokens), 0) * {BUDGET_PERCENT} // 100)::hugeint as budget from leaves)")
    for i, level in enumerate(levels):
        keys, own = ", ".join(levels[:i]), ", ".join(levels[: i + 1])
        part = f"partition by {keys}" if i else ""
        join = f"join b{i} using ({keys})" if i else "cross join b0"
        out.append(f"n{i} as (select *, least(budget, sum(cap) over ({part})) as b, case when weight > 0 then cap::double / weight::double else 0.0 end as ratio from (select {own}, case when {weight(level, WEIGHTS[i])} > 0 then sum(tokens * {MAX_EPOCHS})::hugeint else 0 end as cap, ({weight(level, WEIGHTS[i])})::hugeint as weight from leaves group by {own}) {join})")
        prior = f"over ({part} order by ratio, {level} rows between unbounded preceding and 1 preceding)"
        out.append(f"p{i} as (select *, cap * (sum(weight) over ({part}) - coalesce(sum(weight) {prior}, 0)) <= weight * (b - coalesce(sum(cap) {prior}, 0)) as is_full from n{i})")
        out.append(f"o{i} as (select *, sum(case when is_full then 0 else weight end) over ({part}) as w_open, b - sum(case when is_full then cap else 0 end) over ({part}) as b_open from p{i})")
        out.append(f"s{i} as (select *, case when is_full then cap else (b_open * weight) // greatest(w_open, 1) end as share, case when is_full then -1 else (b_open * weight) % greatest(w_open, 1) end as rest from o{i})")
        out.append(f"b{i + 1} as (select {own}, share + case when not is_full and row_number() over ({part} order by rest desc, {level}) <= b - sum(share) over ({part}) then 1 else 0 end as budget from s{i})")
    out.append("plan as (select domain, lang, source, (budget // tokens)::bigint as full_epochs, (budget % tokens)::bigint as rem from leaves join b3 using (domain, lang, source))")
    out.append(f"seq as (select t.*, p.full_epochs, p.rem, sum(n_tokens) over (partition by t_domain, t_lang, t_source order by md5(concat_ws('|', {quoted(SEED)}, full_epochs::varchar, coalesce(doc_id::varchar, {quoted(NONE)}))), doc_id, n_tokens rows between unbounded preceding and current row) - n_tokens as start from toks t join plan p on t_domain = p.domain and t_lang = p.lang and t_source = p.source where n_tokens > 0)")
    out.append("drawn as (select *, unnest(range(full_epochs)) as epoch, n_tokens as take_tokens from seq union all select *, full_epochs as epoch, least(n_tokens, rem - start) as take_tokens from seq where start < rem)")
    return "with " + ",\n".join(out) + "\nselect doc_id, t_domain as domain, t_lang as lang, t_source as source, epoch::bigint as epoch, n_tokens, take_tokens::bigint as take_tokens from drawn"

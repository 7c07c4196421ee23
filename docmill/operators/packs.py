"""Context packs: blocks rendered below their source's heading, next-fit packing on rendered costs, pack texts, integrity, writing and reading back.

A block is (pack_job, source_id, source_order, display_name, block_order, content, atomic, labels), all but the content not null. Packing goes over costs alone,
in parallel within a job (plans.next_fit), so a job may hold any share of the rows; texts are joined back by block and meet per pack, which the budget bounds
(an atomic block that alone passes the budget makes a pack of its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import TOKEN_SQL, token_estimate
from docmill.operators.blocks import structural_blocks
from docmill.plans.next_fit import place
from docmill.plans.stored import stored
from docmill.registry import query, table

SOFT_TARGET = 0.95
LEAST_BUDGET, MOST_BUDGET = 1_000, 10_000_000
KEY = ["pack_job", "source_order", "block_order"]

# What may stand before a link to assets/, inline code, the opening of a fence, and the two reasons of an overflow that readers of reports know.
_LINK = r"""(?i)(\]\(|\]:\s*|(?:src|href)=["'])(?:\./)?assets/"""
_CODE = r"`+[^`\n]*?`+"
_FENCED = r"^\s*(`{3,}|~{3,})"
ATOMIC_REASON, BUDGET_REASON = "A single atomic Markdown block cannot be safely split.", "Rendered pack exceeds the requested Context Budget."


def check_budget(budget: int | None) -> int | None:
    """The soft target of a budget; no budget has none."""
    if budget is None:
        return None
    if not LEAST_BUDGET <= budget <= MOST_BUDGET:
        raise ValueError(f"a budget lies between {LEAST_BUDGET} and {MOST_BUDGET}, not at {budget}")
    return int(budget * SOFT_TARGET)


def link_assets(content: Column, root: Column) -> Column:
    """Links to assets/ put below root, inline code and fenced blocks left alone."""
    outside = F.transform(F.split(content, _CODE), lambda p: F.regexp_replace(p, F.lit(_LINK), F.concat(F.lit("$1"), root)))
    code = F.regexp_extract_all(content, F.lit(_CODE), F.lit(0))
    return F.when(content.rlike(_FENCED), content).otherwise(F.array_join(F.zip_with(outside, code, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), ""))


def block_id() -> Column:
    return F.concat("source_id", F.format_string("-block-%04d", F.col("block_order")))


def render(header: Column, root: str = "../sources/") -> Column:
    """A block as it stands in a pack, its asset links below root; header: whether its source's heading comes first."""
    labels = F.array_join(F.array_distinct(F.filter("labels", lambda x: x != "")), ", ")
    note = F.concat(F.lit("<!-- block: "), block_id(), F.lit(" | source: "), F.col("source_id"), F.when(labels != "", F.concat(F.lit(" | provenance: "), labels)).otherwise(F.lit("")), F.lit(" -->\n\n"))
    title = F.when(header, F.concat(F.lit("## Source "), F.col("source_id"), F.lit(" — "), F.col("display_name"), F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(title, note, link_assets(F.col("content"), F.concat(F.lit(root), F.col("source_id"), F.lit("/assets/"))))


def assign(blocks: DataFrame, budget: int | None) -> DataFrame:
    """pack_job, source_order, block_order, pack, head for each block; without a budget a job is one pack."""
    target = check_budget(budget)
    if target is None:
        first = F.lag("source_order").over(Window.partitionBy("pack_job", "source_order").orderBy("block_order")).isNull()
        return blocks.select(*KEY, F.lit(1).cast("long").alias("pack"), first.alias("head"))
    first = F.col("block_order") == F.min("block_order").over(Window.partitionBy("pack_job", "source_order"))
    costs = blocks.select(*KEY, token_estimate(render(F.lit(True))).alias("full"), token_estimate(render(F.lit(False))).alias("plain")).withColumn("first", first)
    rows = costs.select(F.col("pack_job").cast("string").alias("job"), F.col("source_order").alias("major"), F.col("block_order").alias("minor"), "full", F.when(F.col("first"), F.col("full")).otherwise(F.col("plain")).alias("rest"))
    placed = place(rows, target)
    opens = F.col("starts") | (F.col("minor") == F.min("minor").over(Window.partitionBy("job", "major")))
    return placed.select(F.col("job").cast("long").alias("pack_job"), F.col("major").alias("source_order"), F.col("minor").alias("block_order"), "pack", opens.alias("head"))


def packs(blocks: DataFrame, placed: DataFrame, budget: int | None) -> DataFrame:
    """pack_job, pack, n_packs, n_blocks, n_sources, estimated_tokens, over_budget, overflow_reason, content of each pack."""
    rows = blocks.join(placed, KEY).select("pack_job", "pack", "source_order", "block_order", "display_name", "atomic", render(F.col("head")).alias("part"))
    p = rows.groupBy("pack_job", "pack").agg(F.array_sort(F.collect_list(F.struct("source_order", "block_order", "display_name", "part"))).alias("b"), F.max(F.coalesce("atomic", F.lit(False))).alias("any_atomic"))
    counts = placed.groupBy("pack_job").agg(F.max("pack").alias("n_packs"))
    p = p.join(counts, "pack_job")
    names = F.transform(F.array_distinct(F.transform("b", lambda x: F.struct(x.source_order.alias("o"), x.display_name.alias("n")))), lambda x: F.concat(F.lit("- "), x.n))
    header = lambda tokens: F.concat(F.lit("# Context Pack "), F.col("pack").cast("string"), F.lit(" of "), F.col("n_packs").cast("string"), F.lit("\n\nEstimated tokens: ~"), tokens, F.lit("\n\nSources included:\n"), F.array_join(names, "\n"), F.lit("\n"))
    body = F.array_join(F.transform("b", lambda x: x.part), "\n\n")
    # The number in the header is one word whatever it is, so any will do for the estimate.
    p = p.withColumn("estimated_tokens", token_estimate(F.concat(header(F.lit("0")), F.lit("\n"), body)))
    over = F.lit(False) if budget is None else F.col("estimated_tokens") > budget
    reason = F.when(over & (F.size("b") == 1) & F.col("any_atomic"), ATOMIC_REASON).when(over, BUDGET_REASON).otherwise("")
    p = p.withColumn("over_budget", over).withColumn("overflow_reason", reason)
    warning = F.when(F.col("over_budget"), F.concat(F.lit("\n> Warning: over budget. "), F.col("overflow_reason"), F.lit("\n"))).otherwise(F.lit(""))
    text = F.concat(F.regexp_replace(F.concat(header(F.col("estimated_tokens").cast("string")), warning, F.lit("\n"), body), r"\s+\z", ""), F.lit("\n"))
    return p.select("pack_job", "pack", "n_packs", F.size("b").cast("long").alias("n_blocks"), F.size(names).cast("long").alias("n_sources"), "estimated_tokens", "over_budget", "overflow_reason", text.alias("content"))


def integrity(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """pack_job, input_blocks, packed_blocks, missing_blocks, duplicate_blocks, order_preserved, complete."""
    want = blocks.groupBy(*KEY).agg(F.count("*").alias("want"))
    got = placed.groupBy(*KEY).agg(F.count("*").alias("got"), F.min("pack").alias("low"), F.max("pack").alias("high"))
    # Packs are runs of the blocks' order: each ends before the next one begins.
    ends = placed.groupBy("pack_job", "pack").agg(F.min(F.struct("source_order", "block_order")).alias("a"), F.max(F.struct("source_order", "block_order")).alias("z"))
    before = F.lag("z").over(Window.partitionBy("pack_job").orderBy("pack"))
    order = ends.withColumn("ok", F.coalesce(before < F.col("a"), F.lit(True))).groupBy("pack_job").agg(F.min("ok").alias("order_preserved"))
    sums = want.join(got, KEY, "full").groupBy("pack_job").agg(
        F.coalesce(F.sum("want"), F.lit(0)).alias("input_blocks"),
        F.coalesce(F.sum("got"), F.lit(0)).alias("packed_blocks"),
        F.count_if(F.col("got").isNull()).alias("missing_blocks"),
        F.coalesce(F.sum(F.greatest(F.col("got") - 1, F.lit(0))), F.lit(0)).alias("duplicate_blocks"),
    )
    rows = sums.join(order, "pack_job", "left").withColumn("order_preserved", F.coalesce("order_preserved", F.lit(True)))
    return rows.withColumn("complete", (F.col("missing_blocks") == 0) & (F.col("duplicate_blocks") == 0) & F.col("order_preserved"))


def source_blocks(sources: DataFrame) -> DataFrame:
    """Blocks of (pack_job, source_order, display_name, content): structural parse, oversized text split, numbered within the source."""
    s = sources.select("pack_job", "source_order", "display_name", F.format_string("source-%03d", "source_order").alias("source_id"), F.col("content").alias("markdown"))
    keys = ("pack_job", "source_order", "display_name", "source_id")
    parsed = structural_blocks(s, keys=keys)
    return parsed.select(*keys, F.col("block_no").cast("long").alias("block_order"), "content", "atomic", F.array(F.concat(F.lit("lines "), F.col("start_line"), F.lit("-"), F.col("end_line"))).alias("labels"))


def write_context_pack(blocks: DataFrame, budget: int | None, path: str) -> None:
    """Writes packs, blocks (with digests) and the integrity record below path; a path that holds a pack already is an error."""
    placed = assign(blocks, budget)
    listed = blocks.join(placed, KEY).select(*KEY, "source_id", block_id().alias("block_id"), "display_name", "content", F.sha2("content", 256).alias("sha256"), "atomic", "labels", "pack", "head")
    listed.write.mode("errorifexists").parquet(f"{path}/blocks")
    stored = blocks.sparkSession.read.parquet(f"{path}/blocks")  # the fold runs once
    packs(stored.select(*blocks.columns), stored.select(*KEY, "pack", "head"), budget).write.mode("errorifexists").parquet(f"{path}/packs")
    integrity(blocks, stored.select(*KEY, "pack")).write.mode("errorifexists").json(f"{path}/integrity")


def source_map(spark: SparkSession, path: str) -> DataFrame:
    """The blocks that a pack lists, with verified: whether the content still has the digest, ids are unique and orders dense within each source."""
    b = spark.read.parquet(f"{path}/blocks")
    n = b.groupBy("pack_job", "source_id").agg(F.count("*").alias("n"), F.max("block_order").alias("top"), F.countDistinct("block_order").alias("k"))
    dense = n.select("pack_job", "source_id", ((F.col("n") == F.col("top")) & (F.col("n") == F.col("k"))).alias("dense"))
    return b.join(dense, ["pack_job", "source_id"]).withColumn("verified", (F.sha2("content", 256) == F.col("sha256")) & F.col("dense"))


def copy_text(packs_: DataFrame, title: str) -> DataFrame:
    """pack_job, text: the packs chosen, in order, below a title; choosing one twice is an error."""
    p = packs_.groupBy("pack_job").agg(F.array_sort(F.collect_list(F.struct("pack", "content"))).alias("p"))
    twice = F.size("p") != F.size(F.array_distinct(F.transform("p", lambda x: x.pack)))
    body = F.array_join(F.transform("p", lambda x: F.rtrim(x.content)), "\n\n---\n\n")
    return p.select("pack_job", F.when(twice, F.raise_error(F.lit("a pack is chosen twice")).cast("string")).otherwise(F.concat(F.lit(f"# {title}\n\n"), body, F.lit("\n"))).alias("text"))


# --- queries: a conversation is a source, a turn a block, sixteen jobs ---------------------------------------------------------------------------


def conversation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") % 16).alias("pack_job"),
        F.col("conv_id").alias("source_order"),
        F.format_string("source-%03d", "conv_id").alias("source_id"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string"), F.lit(".md")).alias("display_name"),
        (F.col("turn") + 1).cast("long").alias("block_order"),
        F.coalesce("text", F.lit("")).alias("content"),
        (F.col("turn") % 3 == 0).alias("atomic"),
        F.array(F.concat(F.lit("Page "), (F.col("turn") + 1).cast("string"))).alias("labels"),
    )


def _tokens(expression: str) -> str:
    return TOKEN_SQL.replace("coalesce(text, '')", expression)


_SQL = f"""
WITH RECURSIVE b AS (SELECT conv_id % 16 AS job, conv_id AS src, turn + 1 AS blk, 'conversation ' || conv_id || '.md' AS name, turn % 3 = 0 AS atomic, 'source-' || printf('%03d', conv_id) AS sid,
 '<!-- block: source-' || printf('%03d', conv_id) || '-block-' || printf('%04d', turn + 1) || ' | source: source-' || printf('%03d', conv_id) || ' | provenance: Page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || coalesce(text, '') AS body FROM conversations),
h AS (SELECT *, '## Source ' || sid || ' — ' || name || chr(10) || chr(10) || body AS full_body, row_number() OVER (PARTITION BY job ORDER BY src, blk) AS i FROM b),
c AS MATERIALIZED (SELECT *, {_tokens('full_body')} AS full_cost, {_tokens('body')} AS cost FROM h),
p AS (SELECT job, src, blk, i, full_cost AS used, CAST(1 AS BIGINT) AS pack, true AS head FROM c WHERE i = 1
 UNION ALL SELECT c.job, c.src, c.blk, c.i,
  CASE WHEN p.used + CASE WHEN c.src = p.src THEN c.cost ELSE c.full_cost END > 1900 THEN c.full_cost ELSE p.used + CASE WHEN c.src = p.src THEN c.cost ELSE c.full_cost END END,
  CASE WHEN p.used + CASE WHEN c.src = p.src THEN c.cost ELSE c.full_cost END > 1900 THEN p.pack + 1 ELSE p.pack END,
  c.src <> p.src OR p.used + c.cost > 1900
 FROM p JOIN c ON c.job = p.job AND c.i = p.i + 1)"""


@query("context_pack_assignment", _SQL + " SELECT job AS pack_job, src AS source_order, CAST(blk AS BIGINT) AS block_order, pack, head FROM p")
def context_pack_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return assign(conversation_blocks(spark, sf), 2000)


_PAGES_SQL = f""", k AS (SELECT p.job, p.pack, count(*) AS n_blocks, count(DISTINCT p.src) AS n_sources, bool_or(atomic) AS atomic, string_agg(CASE WHEN p.head THEN full_body ELSE body END, chr(10) || chr(10) ORDER BY p.i) AS body FROM p JOIN c USING (job, i) GROUP BY p.job, p.pack),
n AS (SELECT job, pack, string_agg('- ' || name, chr(10) ORDER BY src) AS names FROM (SELECT DISTINCT p.job, p.pack, p.src, name FROM p JOIN c USING (job, i)) GROUP BY job, pack),
t AS (SELECT k.*, names, max(k.pack) OVER (PARTITION BY k.job) AS n_packs FROM k JOIN n USING (job, pack)),
e AS (SELECT *, '# Context Pack ' || pack || ' of ' || n_packs || chr(10) || chr(10) || 'Estimated tokens: ~0' || chr(10) || chr(10) || 'Sources included:' || chr(10) || names || chr(10) || chr(10) || body AS page FROM t),
f AS (SELECT *, {_tokens('page')} AS estimated_tokens FROM e)"""


@query("context_packs", _SQL + _PAGES_SQL + f"""
SELECT job AS pack_job, pack, n_packs, n_blocks, n_sources, estimated_tokens, estimated_tokens > 2000 AS over_budget,
 CASE WHEN estimated_tokens > 2000 AND n_blocks = 1 AND atomic THEN '{ATOMIC_REASON}' WHEN estimated_tokens > 2000 THEN '{BUDGET_REASON}' ELSE '' END AS overflow_reason FROM f""")
def context_packs(spark: SparkSession, sf: str) -> DataFrame:
    b = conversation_blocks(spark, sf)
    return packs(b, stored(assign(b, 2000), "placed"), 2000).drop("content")


@query("context_pack_integrity", _SQL + """, n AS (SELECT job, i, pack, CASE WHEN src % 7 = 3 THEN 0 WHEN src % 5 = 2 THEN 2 ELSE 1 END AS n FROM p),
g AS (SELECT job, count(*) AS input_blocks, CAST(sum(n) AS BIGINT) AS packed_blocks, count(*) FILTER (WHERE n = 0) AS missing_blocks, count(*) FILTER (WHERE n = 2) AS duplicate_blocks, NOT (job % 4 = 1 AND count(DISTINCT pack) FILTER (WHERE n > 0) > 1) AS order_preserved FROM n GROUP BY job)
SELECT job AS pack_job, input_blocks, packed_blocks, missing_blocks, duplicate_blocks, order_preserved, missing_blocks = 0 AND duplicate_blocks = 0 AND order_preserved AS complete FROM g""")
def context_pack_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Integrity of packs that lost some sources, hold others twice, and in every fourth job are in reverse order."""
    b = conversation_blocks(spark, sf)
    placed = stored(assign(b, 2000), "placed").filter("source_order % 7 <> 3")
    placed = placed.unionByName(placed.filter("source_order % 5 = 2"))
    return integrity(b, placed.withColumn("pack", F.when(F.col("pack_job") % 4 == 1, -F.col("pack")).otherwise(F.col("pack"))))

"""Table maintenance and lookup lists over orders, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from abspark.functions.scalars import first_with_key
from abspark.operators import aggregates as agg
from abspark.operators import lookups, tables
from abspark.operators.attribution import split_by_policy
from abspark.schemas import EXPERIMENTS, EXPERIMENTS_STAGE
from catalog.registry import placed, query, scratch_folder
from catalog.views import BASE_SQL, base, table

# ---------------------------------------------------------------- registry rows
# The registry holds every customer below 3/4 of the key range, the stage every customer
# above 1/4: both known and new rows, over all export modes, with some invalid ones.
LIMITS = "(SELECT max(c_custkey) AS top FROM customer)"
MODE_SQL = """CASE c_custkey % 4 WHEN 0 THEN 'ANALYZE' WHEN 1 THEN ' update'
    WHEN 2 THEN 'STATUS_ONLY' ELSE 'Other' END"""
CELLS = {
    "date_start": "CAST(DATE '2024-01-01' AS DATE)",
    "date_comparison": "c_custkey % 5 = 0",
    "experiment_name": "'{} ' || c_name",
    "variant_name": "'{} ' || variant",
    "conversion_event": "'{}'",
    "analyze_test": "c_acctbal > 0",
    "confidence": "CAST(c_custkey % 100 AS BIGINT)",
    "description": "'{} about ' || c_mktsegment",
    "scope": "CASE WHEN c_custkey % 2 = 0 THEN 'User' ELSE 'Session' END",
    "analytics_tool": "'{} tool'",
    "query_price_per_tib": "c_acctbal",
}


def cell(name: str, word: str) -> str:
    dtype = dict((f.name, f.dataType.simpleString()) for f in EXPERIMENTS.fields)[name]
    if name == "id":
        return "CASE WHEN c_custkey % 50 = 7 THEN '' ELSE CAST(c_custkey AS VARCHAR(20)) END"
    if name == "variant":
        return "variant"
    return CELLS.get(name, f"CAST(NULL AS {dtype})").format(word)


def registry_select(word: str, extra: str = "") -> str:
    names = [f.name for f in EXPERIMENTS.fields]
    return ", ".join(f"{cell(n, word)} AS {n}" for n in names) + extra


def customer_rows(spark, sf_dir, word, condition, extra=""):
    """Registry-shaped rows of the customers that meet the condition, A and B (and C)."""
    customers = table(spark, sf_dir, "customer")
    top = customers.agg(F.max("c_custkey")).scalar()
    rows = customers.withColumn("top", top).selectExpr(
        "*", "explode(array('A', 'B', 'C')) AS variant"
    )
    return rows.where(condition).selectExpr(
        *[
            f"{cell(n, word)} AS {n}".replace("VARCHAR(20)", "STRING")
            for n in EXPERIMENTS.fieldNames()
        ],
        *([f"{MODE_SQL} AS export_mode"] if extra else []),
    )


OLD = "c_custkey <= top * 0.75 AND variant <> 'C' AND c_custkey % 50 <> 7"
NEW = "c_custkey >= top * 0.25"


def registry_oracle() -> str:
    source = f"""(SELECT *, unnest(['A', 'B', 'C']) AS variant
      FROM customer, {LIMITS})"""
    out = []
    for f in EXPERIMENTS.fields:
        n = f.name
        if n in ("id", "variant"):
            out.append(f"coalesce(s.{n}, t.{n}) AS {n}")
            continue
        branches = f"WHEN s.mode = 'ANALYZE' THEN s.{n}"
        if n in tables.UPDATE_COLUMNS:
            branches += f" WHEN s.mode = 'UPDATE' THEN s.{n}"
        if n == "analyze_test":
            branches += " WHEN s.mode IN ('UPDATE', 'STATUS_ONLY') THEN FALSE"
        out.append(f"CASE {branches} ELSE t.{n} END AS {n}")
    return f"""WITH t AS (SELECT {registry_select('old')} FROM {source} WHERE {OLD}),
    s AS (SELECT {registry_select('new', f', upper(trim({MODE_SQL})) AS mode')}
      FROM {source} WHERE {NEW} AND variant IN ('A', 'B') AND c_custkey % 50 <> 7)
    SELECT {', '.join(out)} FROM t FULL JOIN s ON t.id = s.id AND t.variant = s.variant
    WHERE t.id IS NOT NULL OR s.mode = 'ANALYZE'"""


@query("upsert_registry", registry_oracle())
def _(spark, sf_dir):
    return tables.upsert_registry(
        customer_rows(spark, sf_dir, "old", OLD),
        customer_rows(spark, sf_dir, "new", NEW, extra="mode"),
    )


STAGE_SQL = f"""(SELECT {registry_select('new', f', {MODE_SQL} AS export_mode')}
    FROM (SELECT *, unnest(['A', 'B', 'C']) AS variant FROM customer, {LIMITS})
    WHERE {NEW})"""


@query(
    "load_registry",
    f"SELECT * FROM {STAGE_SQL}",
)
def _(spark, sf_dir):
    stage = customer_rows(spark, sf_dir, "new", NEW, extra="mode").select(
        *EXPERIMENTS_STAGE.fieldNames()
    )
    folder = scratch_folder(spark)
    tables.write_stage(stage, folder)
    return tables.load_registry(spark, folder)


@query(
    "export_summary",
    f"""SELECT count(DISTINCT CASE WHEN export_mode = 'ANALYZE' THEN id END) AS analyzed,
    count(DISTINCT CASE WHEN export_mode = 'UPDATE' THEN id END) AS updated,
    count(DISTINCT CASE WHEN export_mode = 'STATUS_ONLY' THEN id END) AS synced
    FROM {STAGE_SQL} WHERE id <> ''""",
)
def _(spark, sf_dir):
    return agg.export_summary(customer_rows(spark, sf_dir, "new", NEW, extra="mode"))


# ---------------------------------------------------------------- report rows
# The old report is all orders, the new one every third order with changed columns and as
# many orders that are not there yet.
ORDER_COLUMNS = "o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price"
FRESH_SQL = """(SELECT o_orderkey + CASE WHEN o_orderkey % 6 = 0 THEN 100000000000 ELSE 0 END
    AS id, 'new' AS status, o_totalprice * 2 AS price FROM orders WHERE o_orderkey % 3 = 0)"""


def order_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*ORDER_COLUMNS.split(", "))


def fresh_rows(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderkey % 3 = 0")
        .selectExpr(
            "o_orderkey + CASE WHEN o_orderkey % 6 = 0 THEN 100000000000 ELSE 0 END AS id",
            "'new' AS status",
            "o_totalprice * 2 AS price",
        )
    )


@query(
    "upsert_report",
    f"""SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.status ELSE n.status
    END AS status, CASE WHEN n.id IS NULL THEN o.price ELSE n.price END AS price
    FROM (SELECT {ORDER_COLUMNS} FROM orders) o FULL JOIN {FRESH_SQL} n ON o.id = n.id""",
)
def _(spark, sf_dir):
    return tables.upsert_report(order_rows(spark, sf_dir), fresh_rows(spark, sf_dir))


# Lines of an order are its children: orders below the middle date get new ones.
LINE_COLUMNS = "l_orderkey AS id, l_linenumber AS line, l_quantity AS quantity"
CHILD_SQL = """(SELECT o_orderkey AS id, 100 + unnest([1, 2]) AS line, o_totalprice AS quantity
    FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')"""


def line_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*LINE_COLUMNS.split(", "))


def child_stage(spark, sf_dir):
    old = table(spark, sf_dir, "orders").where("o_orderdate < '1996-01-01'")
    return old.selectExpr(
        "o_orderkey AS id", "explode(array(101, 102)) AS line", "o_totalprice AS quantity"
    )


@query(
    "replace_children",
    f"""SELECT {LINE_COLUMNS} FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM {CHILD_SQL})
    UNION ALL SELECT * FROM {CHILD_SQL}""",
)
def _(spark, sf_dir):
    return tables.replace_children(line_rows(spark, sf_dir), child_stage(spark, sf_dir))


@query(
    "replace_filters",
    f"""SELECT {LINE_COLUMNS} FROM lineitem WHERE l_orderkey NOT IN
      (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR
        o_orderdate < TIMESTAMP '1996-01-01') UNION ALL SELECT * FROM {CHILD_SQL}""",
)
def _(spark, sf_dir):
    marked = table(spark, sf_dir, "orders").where(
        "o_orderstatus = 'F' OR o_orderdate < '1996-01-01'"
    )
    return tables.replace_filters(
        line_rows(spark, sf_dir),
        marked.selectExpr("o_orderkey AS id"),
        child_stage(spark, sf_dir),
    )


@query(
    "sync_report_names",
    f"""SELECT c_custkey AS id, CASE WHEN s.id IS NOT NULL THEN s.experiment_name
      ELSE 'old ' || c_name END AS experiment_name, c_acctbal AS mean_value_a
    FROM customer LEFT JOIN {STAGE_SQL} s ON s.id = CAST(c_custkey AS VARCHAR)
      AND upper(trim(s.export_mode)) = 'UPDATE' AND s.variant = 'A'""",
)
def _(spark, sf_dir):
    report = table(spark, sf_dir, "customer").selectExpr(
        "string(c_custkey) AS id", "'old ' || c_name AS experiment_name",
        "c_acctbal AS mean_value_a",
    )
    stage = customer_rows(spark, sf_dir, "new", NEW, extra="mode")
    synced = tables.sync_report_names(report, stage)
    return synced.withColumn("id", F.col("id").cast("bigint"))


DELETED = "c_custkey % 3 = 0"


@query(
    "delete_experiments",
    f"""SELECT 'orders' AS table_name, count(*) AS n FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE {DELETED})
    UNION ALL SELECT 'customer', count(*) FROM customer WHERE NOT ({DELETED})""",
)
def _(spark, sf_dir):
    from abspark.operators.registry import normalize_id

    customers = table(spark, sf_dir, "customer")
    # every third customer; names, 'nan' and the like are no numbers and delete nothing
    gone = customers.where(DELETED).select(
        F.explode(
            F.array(F.col("c_custkey").cast("string"), "c_name", F.lit("nan"),
                    F.concat(F.col("c_custkey") + 1, F.lit("d")))
        ).alias("id")
    )
    left = tables.delete_experiments(
        {
            "orders": table(spark, sf_dir, "orders").select(
                normalize_id(F.col("o_custkey")).alias("id")
            ),
            "customer": customers.select(normalize_id(F.col("c_custkey")).alias("id")),
        },
        gone,
    )
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in left.items()
    ]
    return counts[0].unionByName(counts[1])


JOBS_SQL = """jobs AS (SELECT CAST(o_custkey AS VARCHAR) AS id,
    'job_' || CAST(o_orderkey AS VARCHAR) AS job_id,
    CAST(o_totalprice * 1000 AS BIGINT) * 1000 AS bytes_billed FROM orders)"""
PRICE_SQL = """price AS (SELECT max(c_acctbal) AS p FROM customer WHERE c_mktsegment <> 'BUILDING'
    AND c_custkey % 2 = 0 AND c_acctbal > 0)"""
COST_SQL = f"""WITH {JOBS_SQL}, {PRICE_SQL}, costs AS (SELECT id,
    string_agg(job_id, ', ' ORDER BY job_id) AS job_ids,
    CAST(sum(bytes_billed) AS BIGINT) AS total_bytes_billed FROM jobs GROUP BY id)"""


def job_log(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "string(o_custkey) AS id",
        "'job_' || string(o_orderkey) AS job_id",
        "bigint(round(o_totalprice * 1000)) * 1000 AS bytes_billed",
    )


def price(spark, sf_dir):
    registry = table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment <> 'BUILDING' AS analyze_test",
        "c_custkey % 2 = 0 AS query_information_logging",
        "c_acctbal AS query_price_per_tib",
    )
    return agg.one_price(registry)


@query("one_price", f"WITH {PRICE_SQL} SELECT p AS query_price_per_tib FROM price")
def _(spark, sf_dir):
    return price(spark, sf_dir)


@query(
    "query_cost_rollup",
    f"""{COST_SQL} SELECT id, job_ids, total_bytes_billed,
    round(total_bytes_billed / 1099511627776.0 * (SELECT p FROM price), 6)
      AS estimated_cost_usd FROM costs""",
)
def _(spark, sf_dir):
    costs = agg.query_cost_rollup(job_log(spark, sf_dir), price(spark, sf_dir))
    return costs.withColumn(
        "estimated_cost_usd", F.round(F.col("estimated_cost_usd").cast("double"), 6)
    )


@query(
    "query_cost_pieces",
    f"""WITH {JOBS_SQL}, placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY id
      ORDER BY job_id) - 1) // 3 + 1 AS INTEGER) AS piece FROM jobs)
    SELECT id, piece, string_agg(job_id, ', ' ORDER BY job_id) AS job_ids,
      CAST(sum(bytes_billed) AS BIGINT) AS bytes_billed FROM placed GROUP BY id, piece""",
)
def _(spark, sf_dir):
    return agg.cost_pieces(job_log(spark, sf_dir), jobs_per_piece=3)


@query(
    "cost_rows",
    f"""WITH {JOBS_SQL}, {PRICE_SQL}, every AS (SELECT * FROM jobs UNION ALL
      SELECT (SELECT min(id) FROM jobs), 'merge_' || CAST(s_suppkey AS VARCHAR), s_suppkey * 1000000
      FROM supplier)
    SELECT id, TIMESTAMP '2024-03-01 00:00:00' AS execution_time,
      string_agg(job_id, ', ' ORDER BY job_id) AS job_ids,
      CAST(sum(bytes_billed) AS BIGINT) AS total_bytes_billed,
      round(sum(bytes_billed) / 1099511627776.0 * (SELECT p FROM price), 6) AS estimated_cost_usd
    FROM every GROUP BY id""",
)
def _(spark, sf_dir):
    merges = table(spark, sf_dir, "supplier").selectExpr(
        "'merge_' || s_suppkey AS job_id", "s_suppkey * 1000000 AS bytes_billed"
    )
    when = F.lit("2024-03-01").cast("timestamp")
    rows = agg.cost_rows(job_log(spark, sf_dir), price(spark, sf_dir), merges, when)
    return rows.withColumn(
        "estimated_cost_usd", F.round(F.col("estimated_cost_usd").cast("double"), 6)
    )


def cost_table(spark, sf_dir):
    costs = agg.query_cost_rollup(job_log(spark, sf_dir), price(spark, sf_dir))
    days = F.make_interval(days=(F.col("id").cast("int") % 28))
    return costs.withColumn(
        "execution_time", F.lit("2024-01-01").cast("timestamp") + days
    )


@query(
    "delete_query_info",
    f"""{COST_SQL} SELECT id, job_ids FROM costs WHERE job_ids NOT IN
      (SELECT job_ids FROM costs WHERE CAST(id AS BIGINT) % 3 = 0)""",
)
def _(spark, sf_dir):
    costs = cost_table(spark, sf_dir)
    gone = costs.where(F.col("id").cast("bigint") % 3 == 0).select("job_ids")
    return tables.delete_query_info(costs, gone).select("id", "job_ids")


UNIT_SQL = """CASE WHEN total_bytes_billed >= 1099511627776 THEN 4
    WHEN total_bytes_billed >= 1073741824 THEN 3 WHEN total_bytes_billed >= 1048576 THEN 2
    WHEN total_bytes_billed >= 1024 THEN 1 ELSE 0 END"""


def bytes_sql(column: str) -> str:
    unit = UNIT_SQL.replace("total_bytes_billed", column)
    return rf"""CASE WHEN coalesce({column}, 0) = 0 THEN '0 B' ELSE
      regexp_replace(CAST(round({column} / power(1024.0, {unit}), 2) AS VARCHAR), '\.0$', '')
      || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][{unit} + 1] END"""


@query(
    "download_query_info",
    f"""{COST_SQL} SELECT id, epoch_us(TIMESTAMP '2024-01-01'
      + to_days(CAST(CAST(id AS BIGINT) % 28 AS INTEGER))) AS micros, job_ids,
    total_bytes_billed, {bytes_sql('total_bytes_billed')} AS bytes_text,
    row_number() OVER (ORDER BY CAST(id AS BIGINT) % 28 DESC, id DESC) AS place FROM costs""",
)
def _(spark, sf_dir):
    return placed(lookups.download_query_info(cost_table(spark, sf_dir))).select(
        "id", F.unix_micros("execution_time").alias("micros"), "job_ids",
        "total_bytes_billed", "bytes_text", "place",
    )


@query(
    "format_bytes",
    f"""SELECT o_orderkey, {bytes_sql('bytes')} AS text FROM (SELECT o_orderkey,
    CAST(CASE WHEN o_orderkey % 9 = 8 THEN 0 ELSE
      power(10, o_orderkey % 14) * (o_orderkey % 1000) END AS BIGINT) AS bytes FROM orders)""",
)
def _(spark, sf_dir):
    amount = F.expr(
        "bigint(CASE WHEN o_orderkey % 9 = 8 THEN 0 ELSE "
        "power(10, o_orderkey % 14) * (o_orderkey % 1000) END)"
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", lookups.format_bytes(amount).alias("text")
    )


# ---------------------------------------------------------------- lookup lists
NAMES_SQL = f"""WITH {BASE_SQL}, events_list AS (SELECT DISTINCT 'EVENT' AS scope,
    event_type AS name FROM base), users_list AS (SELECT DISTINCT 'USER' AS scope,
    tier AS name FROM base WHERE tier IS NOT NULL)"""


def event_list(b):
    return b.select(F.lit("EVENT").alias("scope"), F.col("event_type").alias("name")).distinct()


def user_list(b):
    return b.where("tier IS NOT NULL").select(
        F.lit("USER").alias("scope"), F.col("tier").alias("name")
    ).distinct()


@query("union_distinct", f"{NAMES_SQL} SELECT * FROM events_list UNION SELECT * FROM users_list")
def _(spark, sf_dir):
    b = base(spark, sf_dir)
    return lookups.union_distinct(event_list(b), user_list(b), event_list(b))


@query(
    "merge_lookup_lists",
    """SELECT DISTINCT trim(p_brand) AS name, p_type AS scope FROM part
    UNION SELECT DISTINCT trim(p_name), 'NAME' FROM part WHERE p_size % 2 = 0""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brands = part.select(
        F.concat(F.lit(" \t"), "p_brand", F.lit("\n")).alias("name"),
        F.col("p_type").alias("scope"),
    )
    names = part.select(
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  ").alias("name"),
        F.lit("NAME").alias("scope"),
    )
    return lookups.merge_lookup_lists(brands, names)


@query(
    "with_default_entry",
    f"""{NAMES_SQL} SELECT * FROM events_list UNION SELECT 'EVENT', 'exposure'""",
)
def _(spark, sf_dir):
    listed = event_list(base(spark, sf_dir))
    once = lookups.with_default_entry(listed, scope="EVENT", name=" exposure ")
    again = lookups.with_default_entry(once, scope="EVENT", name="view")
    return lookups.with_default_entry(again, scope="EVENT", name=" ")


@query(
    "lookup_table",
    "SELECT o_orderkey AS name, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders",
)
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"))
    return placed(lookups.lookup_table(keys, ["name"]))


@query(
    "lookup_order",
    f"""{NAMES_SQL} SELECT *, row_number() OVER (ORDER BY scope, name) AS place
    FROM (SELECT * FROM events_list UNION ALL SELECT * FROM users_list)""",
)
def _(spark, sf_dir):
    b = base(spark, sf_dir)
    both = event_list(b).unionByName(user_list(b))
    return placed(lookups.lookup_order(both, "scope", "name"))


@query(
    "results_order",
    """SELECT o_orderkey AS id, o_orderdate::DATE AS date_end, row_number() OVER
    (ORDER BY o_orderstatus = 'F' DESC, o_orderkey DESC) AS place FROM orders""",
)
def _(spark, sf_dir):
    report = table(spark, sf_dir, "orders").selectExpr(
        "string(o_orderkey) AS id", "o_orderstatus = 'F' AS analyze_test",
        "date('2024-01-01') AS date_last_analyzed", "date(o_orderdate) AS date_end",
    )
    ordered = placed(report.orderBy(*lookups.results_order()))
    return ordered.select(F.col("id").cast("bigint").alias("id"), "date_end", "place")


@query(
    "query_info_order",
    f"""{COST_SQL} SELECT id, job_ids, row_number() OVER
    (ORDER BY CAST(id AS BIGINT) % 28 DESC, id DESC) AS place FROM costs""",
)
def _(spark, sf_dir):
    ordered = placed(cost_table(spark, sf_dir).orderBy(*lookups.query_info_order()))
    return ordered.select("id", "job_ids", "place")


POLICY_SQL = """CASE o_orderkey % 6 WHEN 0 THEN 'First Exposure' WHEN 1 THEN 'Last Exposure'
    WHEN 2 THEN 'Exclude' WHEN 3 THEN 'Credit Both' WHEN 4 THEN 'first exposure' END"""


@query(
    "split_by_policy",
    f"""SELECT o_orderkey AS id, policy IS NOT NULL AND policy IN ('First Exposure',
    'Last Exposure', 'Exclude', 'Credit Both') AS valid
    FROM (SELECT o_orderkey, {POLICY_SQL} AS policy FROM orders)""",
)
def _(spark, sf_dir):
    registry = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", f"{POLICY_SQL} AS user_overlap"
    )
    valid, skipped = split_by_policy(registry)
    return valid.select("id", F.lit(True).alias("valid")).unionByName(
        skipped.select("id", F.lit(False).alias("valid"))
    )


@query(
    "id_semi_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE l_orderkey IN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(spark, sf_dir):
    staged = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    ids = staged.select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.rows_with_ids(lines, ids, "l_orderkey")


@query(
    "id_anti_join",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IS NULL OR o_custkey
    NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.rows_without_ids(orders, ids.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query(
    "first_match_in_array",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderpriority
    WHEN 'O' THEN CAST(o_custkey AS VARCHAR) || 'F' END AS found FROM orders""",
)
def _(spark, sf_dir):
    # F: the first of two equal keys; O: the second entry; other states have no entry
    entries = F.expr(
        "array(named_struct('key', nullif(o_orderstatus, 'O'), 'value', o_orderpriority), "
        "named_struct('key', 'O', 'value', string(o_custkey) || 'F'), "
        "named_struct('key', 'F', 'value', 'second'))"
    )
    found = F.when(F.col("o_orderstatus") == "F", first_with_key(entries, "F")["value"]).when(
        F.col("o_orderstatus") == "O", first_with_key(entries, "O")["value"]
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("found"))

"""The engine's inputs over the driver's tables, in Spark's SQL and in DuckDB's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = {"spark": "timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)", "duckdb": "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts)"}
DAYS = {"spark": "timestampdiff(DAY, TIMESTAMP_NTZ '1995-01-01 00:00:00', l_shipdate)", "duckdb": "date_diff('day', TIMESTAMP '1995-01-01 00:00:00', l_shipdate)"}
TEXT = {"spark": "STRING", "duckdb": "VARCHAR"}
#: Width of the regular tile over `frag`, and number of rule-based states.
WIDTH, STATES = 3600, 3

#: name: (table that it reads, SQL)
VIEWS = {
    "frag": (
        "events",
        """SELECT event_type AS chrom, {SEC} AS start, {SEC} + 1 + CAST(floor(value) AS BIGINT) AS stop,
    concat('u', CAST(user_id AS {STR})) AS barcode, CAST(1 AS INT) AS dup FROM events""",
    ),
    "aln": (
        "lineitem",
        """SELECT concat(CAST(l_orderkey AS {STR}), ':', CAST(l_linenumber AS {STR})) AS qname,
    concat('chr', CAST(l_suppkey % 5 AS {STR})) AS rname, concat('chr', CAST(l_suppkey % 5 AS {STR})) AS mname,
    {DAY} * 200 + l_partkey % 200 AS pos,
    greatest(0, {DAY} * 200 + l_partkey % 200 + (CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END) * (CAST(l_quantity AS BIGINT) * 50 - 50)) AS mpos,
    (CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END) * CAST(l_quantity AS BIGINT) * 50 AS tlen,
    CAST(50 AS BIGINT) AS rlen, CAST(round(l_tax * 100) AS INT) * 8 AS mapq,
    (CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) + (CASE WHEN l_returnflag = 'N' THEN 2 ELSE 0 END)
      + (CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END)
      + (CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END) AS flag,
    CASE WHEN l_discount < 0.005 THEN NULL ELSE concat('c', CAST(l_suppkey % 40 AS {STR})) END AS tag_cb FROM lineitem""",
    ),
    "cellgroup": ("events", "SELECT DISTINCT concat('u', CAST(user_id AS {STR})) AS barcode, concat('g', CAST(user_id % 7 AS {STR})) AS grp FROM events"),
    "genes": (
        "orders",
        """SELECT CASE o_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS chrom,
    (o_orderkey * 7919) % 2592000 AS start,
    (o_orderkey * 7919) % 2592000 + 500 + CAST(floor(o_totalprice) AS BIGINT) % 5000 AS stop,
    concat('o', CAST(o_orderkey AS {STR})) AS name, CASE o_orderstatus WHEN 'F' THEN '-' ELSE '+' END AS strand,
    o_orderpriority AS geneset FROM orders""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, without registering anything in the session."""
    source, sql = VIEWS[name]
    text = sql.format(SEC=SECONDS["spark"], DAY=DAYS["spark"], STR=TEXT["spark"])
    columns, _, _ = text.removeprefix("SELECT ").rpartition(" FROM ")
    distinct = columns.startswith("DISTINCT ")
    rows = spark.sql(f"SELECT {columns.removeprefix('DISTINCT ')} FROM {{source}}", source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))
    return rows.distinct() if distinct else rows


#: CTEs for DuckDB, each with those that it needs.
CTES = {name: sql.format(SEC=SECONDS["duckdb"], DAY=DAYS["duckdb"], STR=TEXT["duckdb"]) for name, (_, sql) in VIEWS.items()}
CTES |= {
    "sizes": "SELECT chrom, max(stop) AS size FROM frag GROUP BY chrom",
    "offsets": f"SELECT chrom, size, CAST(coalesce(sum(CAST(ceil(size / {WIDTH}.0) AS BIGINT)) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM sizes",
    "tile": f"""SELECT off + i AS ridx, chrom, i * {WIDTH} AS start, least((i + 1) * {WIDTH}, size) AS stop
    FROM (SELECT *, unnest(range(CAST(ceil(size / {WIDTH}.0) AS BIGINT))) AS i FROM offsets)""",
    "counts": f"""SELECT t.ridx AS ridx, f.barcode AS barcode, count(*) AS cnt FROM frag f JOIN tile t
    ON f.chrom = t.chrom AND f.start < t.stop AND t.start < f.stop GROUP BY ALL""",
    "depth": "SELECT t.ridx AS ridx, CAST(coalesce(sum(c.cnt), 0) AS BIGINT) AS readdepth FROM tile t LEFT JOIN counts c ON t.ridx = c.ridx GROUP BY ALL",
    "seg": f"SELECT t.ridx AS ridx, t.chrom AS chrom, t.start AS start, t.stop AS stop, d.readdepth AS readdepth, CAST((t.ridx * 7 + d.readdepth) % {STATES} AS INT) AS state FROM tile t JOIN depth d ON t.ridx = d.ridx",
    "pi": "SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 0.3::DOUBLE), (2, 0.2::DOUBLE)) v(state, p)",
}
NEEDS = {"sizes": ["frag"], "offsets": ["sizes"], "tile": ["offsets"], "counts": ["tile", "frag"], "depth": ["counts"], "seg": ["tile", "depth"]}
PI = {0: 0.5, 1: 0.3, 2: 0.2}


def oracle(query: str, *names: str, **more: str) -> str:
    """DuckDB SQL: a query behind the CTEs that it names, their needs first, and further ones of its own."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + query


def stationary(spark: SparkSession) -> DataFrame:
    """(state, p) of the rule-based states: constants that both engines use."""
    return spark.createDataFrame(sorted(PI.items()), "state int, p double")


def rule_segments(regions: DataFrame, totals: DataFrame) -> DataFrame:
    """Segments whose state is a rule, so that any engine can compute them. totals: (ridx, total)."""
    rows = regions.join(totals.select("ridx", F.col("total").alias("readdepth")), "ridx")
    state = F.pmod(F.col("ridx") * 7 + F.col("readdepth"), F.lit(STATES)).cast("int")
    rows = rows.withColumn("state", state).withColumn("name", F.concat(F.lit("state_"), state.cast("string")))
    probs = {f"Prob_state_{i}": F.when(F.col("state") == i, 0.6 + 0.4 / (1 + F.col("readdepth"))).otherwise(0.2 - 0.2 / (1 + F.col("readdepth"))) for i in range(STATES)}
    return rows.withColumns(probs).withColumn("Prob_max", F.greatest(*probs))

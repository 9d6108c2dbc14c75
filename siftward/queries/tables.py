"""The given tables, and the registry tables that are derived from them.

The registry tables imitate release metadata and a download log by joins of
the given tables. The same text defines them in Spark and in the oracle.
"""

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftward.operators.skew import use_all_cores

RELEASES_AS_OF = datetime(2001, 12, 1)
DOWNLOADS_AS_OF = datetime(2024, 1, 31, 12)

# Unique within a package, so that "latest" has one answer.
ORDER = ("upload_time", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")

NAME = """CASE WHEN p.p_partkey % 5 = 0 THEN concat('py', p.p_type, CAST(p.p_partkey AS STRING))
 WHEN p.p_partkey % 5 = 1 THEN concat(p.p_brand, '_', CAST(p.p_partkey AS STRING))
 ELSE concat(replace(p.p_name, ' ', '-'), '-', CAST(p.p_partkey AS STRING)) END"""

DIST = f"""
SELECT
 {NAME} AS name,
 concat(CAST(l.l_linenumber AS STRING), '.', CAST(l.l_suppkey % 3 AS STRING)) AS version,
 l.l_shipdate AS upload_time,
 split_part(d.text, chr(10), 1) AS summary,
 CASE WHEN p.p_partkey % 3 = 0 THEN d.text || chr(10) || 'See ' || coalesce(g.url, 'https://example.org') || ' ```x```'
      WHEN p.p_partkey % 7 = 0 THEN d.text || ' bitcoin' ELSE d.text END AS description,
 p.p_brand AS author,
 CASE WHEN p.p_partkey % 6 = 0 THEN NULL ELSE concat('user', CAST(l.l_suppkey % 20 AS STRING),
   CASE l.l_suppkey % 4 WHEN 0 THEN '@gmail.com' WHEN 1 THEN '@mailinator.com' WHEN 2 THEN '@corp.example.com' ELSE '@outlook.com' END) END AS author_email,
 CASE WHEN l.l_linestatus = 'F' THEN concat('m', CAST(l.l_suppkey % 10 AS STRING), '@yahoo.com') END AS maintainer_email,
 CASE l.l_returnflag WHEN 'A' THEN 'MIT License' WHEN 'R' THEN '' END AS license,
 p.p_type AS keywords,
 g.url AS home_page,
 CASE WHEN p.p_partkey % 11 = 0 THEN 'https://gitlab.com/dl' END AS download_url,
 split(CASE p.p_partkey % 3 WHEN 0 THEN 'License :: OSI Approved :: Apache License;Programming Language :: Python :: 3'
                            WHEN 1 THEN 'Typing :: Typed;Topic :: Text' END, ';') AS classifiers,
 split(CASE p.p_partkey % 4 WHEN 0 THEN concat('Source, https://github.com/x/', CAST(p.p_partkey AS STRING), ';Tracker, https://github.com/x/y/issues')
                            WHEN 1 THEN 'Docs, https://docs.example.org/' END, ';') AS project_urls,
 split(CASE l.l_linenumber % 3 WHEN 0 THEN concat('django>=', CAST(l.l_linenumber AS STRING), '#flsk (>=1)#lib', CAST(l.l_suppkey AS STRING), '[x]; extra == "t"')
                               WHEN 1 THEN concat('pySMALL', CAST(l.l_suppkey * 5 AS STRING), '==1.0') END, '#') AS requires_dist,
 l.l_linestatus = 'F' AS has_signature,
 l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice, p.p_partkey
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey
LEFT JOIN {{documents}} d ON d.doc_id = p.p_partkey
LEFT JOIN {{pages}} g ON g.page_id = p.p_partkey
"""

# Tables that grow with the data; small copies of them are one split each.
_LARGE = ("lineitem", "events", "documents")

_GIVEN = {t: t for t in ("lineitem", "part", "documents", "pages")}

# Derived tables as the oracle sees them.
ORACLE_TABLES = {
    "dist": DIST.format(**_GIVEN),
    "part_names": f"SELECT p.p_partkey, {NAME} AS name FROM part p",
    "ground_truth": """SELECT DISTINCT name AS package_name, toxic AS is_spam
        FROM dist JOIN labels ON doc_id = p_partkey""",
    "sample": """SELECT package_name FROM ground_truth WHERE is_spam = 1
        UNION ALL SELECT package_name FROM ground_truth WHERE is_spam = 0""",
    "downloads": """SELECT e.ts AS timestamp, {'project': n.name} AS file
        FROM events e JOIN part_names n ON e.user_id = n.p_partkey""",
    "newest": """SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY name ORDER BY
        upload_time DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC,
        l_extendedprice DESC) = 1""",
}
_NEEDS = {
    "ground_truth": ["dist"],
    "sample": ["ground_truth"],
    "downloads": ["part_names"],
    "newest": ["dist"],
}


def oracle_prefix(tables: tuple[str, ...]) -> str:
    """WITH clause that defines derived tables and what they are made of."""
    wanted: list[str] = []

    def want(table: str) -> None:
        for needed in _NEEDS.get(table, []):
            want(needed)
        if table not in wanted:
            wanted.append(table)

    for table in tables:
        want(table)
    return "WITH " + ",\n".join(f"{t} AS ({ORACLE_TABLES[t]})" for t in wanted) + "\n"


class Tables:
    """Tables of one folder; a given table by its name, a derived one as property."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.stored(name)
        return use_all_cores(table) if name in _LARGE else table

    @cached_property
    def dist(self) -> DataFrame:
        return self.spark.sql(
            DIST,
            lineitem=self.lineitem,
            part=self.part,
            documents=self.stored("documents"),
            pages=self.pages,
        )

    @cached_property
    def part_names(self) -> DataFrame:
        return self.part.alias("p").select("p_partkey", F.expr(NAME).alias("name"))

    @cached_property
    def ground_truth(self) -> DataFrame:
        named = self.part_names.join(self.labels, F.col("doc_id") == F.col("p_partkey"))
        return named.select(
            F.col("name").alias("package_name"), F.col("toxic").alias("is_spam")
        )

    @cached_property
    def spam_names(self) -> DataFrame:
        return self.ground_truth.filter("is_spam = 1").select("package_name")

    @cached_property
    def good_names(self) -> DataFrame:
        return self.ground_truth.filter("is_spam = 0").select("package_name")

    @cached_property
    def unlabelled_names(self) -> DataFrame:
        known = F.col("doc_id") == F.col("p_partkey")
        return self.part_names.join(self.labels, known, "left_anti").select("name").distinct()

    @cached_property
    def downloads(self) -> DataFrame:
        named = self.events.join(self.part_names, F.col("user_id") == F.col("p_partkey"))
        return named.select(
            F.col("ts").alias("timestamp"), F.struct(F.col("name").alias("project")).alias("file")
        )

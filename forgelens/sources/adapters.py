"""The engine's tables read from the star-schema Parquet files used for checks and benches.

Each adapter is one SELECT that Spark and other SQL engines run alike; ``{bytes}`` stands for the
function giving the UTF-8 length of a string.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from forgelens.tables import with_file_defaults

COMMITS_SQL = """
SELECT o_orderpriority AS repo, o_orderkey AS seq, CAST(o_orderkey AS STRING) AS commit_hash,
       'Dev ' || CAST(o_custkey % 37 AS STRING) AS author_name,
       CASE WHEN o_orderkey % 5 = 0 THEN ' DEV' ELSE 'dev' END
         || CAST(CASE WHEN o_custkey % 10 < 6 THEN o_custkey % 3 ELSE o_custkey % 37 END AS STRING)
         || '@example.com' AS author_email,
       o_orderdate AS authored_at,
       CASE o_orderkey % 6 WHEN 0 THEN 'fix' WHEN 1 THEN 'Merge branch topic' WHEN 2 THEN '  wip  '
            WHEN 3 THEN 'update order ' || CAST(o_orderkey AS STRING)
            ELSE 'implement ' || lower(o_orderpriority) END AS message
FROM orders"""

COMMIT_FILES_SQL = """
SELECT o_orderpriority AS repo, CAST(l_orderkey AS STRING) AS commit_hash, l_linenumber AS ordinal,
       'pkg' || CAST(l_partkey % 20 AS STRING) || '/mod' || CAST(l_partkey % 400 AS STRING) || '.py' AS path,
       CAST(l_quantity AS BIGINT) AS insertions, CAST(round(l_discount * 100) AS BIGINT) AS deletions
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

LOG_RECORDS_SQL = """
SELECT c.repo, c.seq - c.seq % 65536 AS block, c.seq AS place, c.header, coalesce(l.body, '') AS body
FROM (SELECT o_orderpriority AS repo, o_orderkey AS seq, CAST(o_orderkey AS STRING) AS commit_hash,
             CASE WHEN o_orderkey % 23 = 0 THEN 'damaged'
                  ELSE CAST(o_orderkey AS STRING) || '|Dev ' || CAST(o_custkey % 37 AS STRING) || '|dev' || CAST(o_custkey % 37 AS STRING)
                       || '@example.com|' || CASE WHEN o_orderkey % 19 = 0 THEN 'soon' ELSE CAST(1000000000 + o_custkey AS STRING) END
                       || '|' || CASE WHEN o_orderkey % 6 = 1 THEN 'Merge a | b' ELSE 'order ' || o_orderstatus END END AS header
      FROM orders) c
LEFT JOIN (SELECT commit_hash, array_join(transform(array_sort(collect_list(struct(ordinal, line))), x -> x.line), chr(10)) AS body
           FROM (SELECT CAST(l_orderkey AS STRING) AS commit_hash, l_linenumber AS ordinal,
                        CASE WHEN l_linenumber % 4 = 0 THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END || chr(9)
                          || CAST(l_linenumber AS STRING) || CASE WHEN l_partkey % 11 = 0 THEN '' ELSE chr(9) || 'mod' || CAST(l_partkey AS STRING) || '.py' END AS line
                 FROM lineitem) GROUP BY commit_hash) l ON c.commit_hash = l.commit_hash"""

DOCUMENT_FILES_SQL = """
SELECT source AS repo, doc_id AS seq,
       CASE doc_id % 6 WHEN 0 THEN 'src/core/' WHEN 1 THEN 'src/utils/' WHEN 2 THEN 'pkg/tests/'
            WHEN 3 THEN 'docs/' WHEN 4 THEN 'node_modules/x/' ELSE '' END
         || CASE WHEN doc_id % 7 = 0 THEN 'test_' ELSE 'f' END || CAST(doc_id AS STRING)
         || CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.md' WHEN 3 THEN '.java'
                 WHEN 4 THEN '.go' WHEN 5 THEN '.txt' WHEN 6 THEN '.PY' ELSE '' END AS path,
       text, {bytes}(text) AS size_bytes, doc_id % 11 = 0 AS is_symlink, doc_id % 13 = 0 AS is_executable
FROM (SELECT doc_id, source,
             CASE WHEN doc_id % 29 = 0 THEN 'x' || chr(0) ELSE '' END
               || replace(replace(replace(replace(text, '. ', chr(13) || chr(10) || '# '), ', ', chr(10) || '  ' || chr(10)),
                          ' re', chr(11) || '  // '), 'th ', 'if ')
               || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END AS text
      FROM documents)"""

ROOT_FILES_SQL = """
SELECT 'r' || CAST(CAST(floor(doc_id / 14.0) AS INT) AS STRING) AS repo, doc_id AS seq,
       CASE WHEN doc_id * 7 % 5 = 0 THEN 'other/f' || CAST(doc_id AS STRING) || '.txt' ELSE CASE doc_id % 14 WHEN 0 THEN 'README.md' WHEN 1 THEN 'CONTRIBUTING.md' WHEN 2 THEN 'CHANGELOG.md'
            WHEN 3 THEN 'requirements.txt' WHEN 4 THEN 'pyproject.toml' WHEN 5 THEN 'package.json' WHEN 6 THEN 'pom.xml'
            WHEN 7 THEN '.github/workflows/ci.yml' WHEN 8 THEN '.gitlab-ci.yml' WHEN 9 THEN '.travis.yml'
            WHEN 10 THEN 'Jenkinsfile' WHEN 11 THEN '.gitignore' WHEN 12 THEN 'src/a.py' ELSE 'tests/test_a.py' END END AS path,
       text, {bytes}(text) AS size_bytes, false AS is_symlink, false AS is_executable
FROM (SELECT doc_id, replace(text, '. ', chr(10)) AS text FROM documents)"""

PAGE_FILES_SQL = """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, page_id AS seq,
       regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path, html AS text, {bytes}(html) AS size_bytes,
       false AS is_symlink, false AS is_executable
FROM pages"""

OCCURRENCES_SQL = """
SELECT p_type AS repo, CAST(floor(p_partkey / 40.0) AS INT) AS file_seq, CAST(p_partkey % 40 AS INT) AS entry_seq,
       CASE WHEN p_partkey % 4 = 0 THEN upper(replace(p_name, ' ', '-')) ELSE replace(p_name, ' ', '-') END AS name,
       CASE WHEN p_partkey % 9 = 0 THEN NULL
            ELSE CAST(p_size % 3 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || '.0'
                 || CASE WHEN p_partkey % 13 = 0 THEN '-alpha' WHEN p_partkey % 17 = 0 THEN '-dev' ELSE '' END
       END AS version,
       CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'jvm' END AS source,
       CASE p_partkey % 5 WHEN 0 THEN 'development' WHEN 1 THEN 'optional' WHEN 2 THEN 'peer' ELSE 'runtime' END AS dep_type
FROM part"""

REQUIREMENT_LINES_SQL = """
SELECT p_type AS repo, p_partkey AS entry_seq,
       CASE WHEN p_partkey % 12 = 0 THEN '# section ' || p_brand WHEN p_partkey % 14 = 0 THEN '   '
            ELSE replace(p_name, ' ', '-') || CASE p_partkey % 6 WHEN 0 THEN '==' WHEN 1 THEN '>=' WHEN 2 THEN '~='
                 WHEN 3 THEN ' < ' WHEN 4 THEN '^' ELSE '' END
                 || CASE WHEN p_partkey % 6 = 5 THEN '' ELSE CAST(p_size % 4 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) END
       END AS line
FROM part"""


class Inputs:
    """The adapted tables of one data directory, built lazily."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self._tables[name]

    def _adapt(self, sql: str, *names: str) -> DataFrame:
        text = sql.format(bytes="octet_length")
        for name in names:
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **{name: self.table(name) for name in names})

    @cached_property
    def commits(self) -> DataFrame:
        return self._adapt(COMMITS_SQL, "orders")

    @cached_property
    def commit_files(self) -> DataFrame:
        return self._adapt(COMMIT_FILES_SQL, "lineitem", "orders")

    @cached_property
    def log_records(self) -> DataFrame:
        """Histories as exported logs hold them: a header line and a change list for each commit."""
        return self._adapt(LOG_RECORDS_SQL, "orders", "lineitem")

    @staticmethod
    def _with_content(files: DataFrame) -> DataFrame:
        columns = (
            "repo", "seq", "path", "cast(text AS binary) AS content",
            "bigint(size_bytes) AS size_bytes", "is_symlink", "is_executable",
        )
        return with_file_defaults(files.selectExpr(*columns))

    @cached_property
    def files(self) -> DataFrame:
        return self._with_content(self._adapt(DOCUMENT_FILES_SQL, "documents"))

    @cached_property
    def root_files(self) -> DataFrame:
        return self._with_content(self._adapt(ROOT_FILES_SQL, "documents"))

    @cached_property
    def page_files(self) -> DataFrame:
        return self._with_content(self._adapt(PAGE_FILES_SQL, "pages"))

    @cached_property
    def occurrences(self) -> DataFrame:
        return self._adapt(OCCURRENCES_SQL, "part")

    @cached_property
    def requirement_lines(self) -> DataFrame:
        return self._adapt(REQUIREMENT_LINES_SQL, "part")

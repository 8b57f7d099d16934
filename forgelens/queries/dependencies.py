"""Queries over dependency manifests and dependency rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.functions import versions
from forgelens.functions.sql import exprs
from forgelens.functions.text import strip
from forgelens.operators import conflicts as cf
from forgelens.operators import dependencies as d
from forgelens.operators import graph as g
from forgelens.plans import dependency_reports as reports
from forgelens.queries.common import LICENSE_RULES, query
from forgelens.sources import manifests as m
from forgelens.sources.adapters import Inputs
from forgelens.tables import repos_of


def deps_of(x: Inputs) -> DataFrame:
    return d.dependencies(x.occurrences, LICENSE_RULES)


def dep_repos(x: Inputs) -> DataFrame:
    return repos_of(x.occurrences)


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as comma-separated text, for comparison."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


# Specifications and manifests

NORMAL = """CASE WHEN coalesce(v, '') = '' THEN NULL
  WHEN regexp_matches(v, '[0-9a-zA-Z.\\-+]') THEN regexp_extract(v, '[0-9a-zA-Z.\\-+]+') ELSE trim(v) END"""


@query(
    "split_specifications",
    """, s AS (SELECT repo, entry_seq, trim(line) AS line FROM req)
       SELECT repo, entry_seq, CASE WHEN contains(line, '==') THEN split_part(line, '==', 1) WHEN contains(line, '>=') THEN split_part(line, '>=', 1)
           WHEN contains(line, '~=') THEN split_part(line, '~=', 1) WHEN contains(line, '<') THEN trim(split_part(line, '<', 1))
           WHEN contains(line, '^') THEN split_part(line, '^', 1) ELSE line END AS name,
         CASE WHEN regexp_matches(line, '==|>=|~=|<|\\^') THEN regexp_extract(line, '(==|>=|~=|<|\\^) *(.*)$', 2) END AS version
       FROM s WHERE line <> '' AND NOT starts_with(line, '#')""",
    "req",
)
def split_specifications(x: Inputs) -> DataFrame:
    stripped = x.requirement_lines.selectExpr("repo", "entry_seq", f"{strip('line')} AS line")
    kept = stripped.where("line <> '' AND NOT startswith(line, '#')")
    spec = exprs(spec=f"{versions.split_specs('array(line)')}[0]")
    return kept.select("repo", "entry_seq", *spec).select("repo", "entry_seq", "spec.*")


@query(
    "normalized_versions",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 6 THEN NULL WHEN p_partkey % 7 = 5 THEN '*' ELSE p_size || '.' || (p_partkey % 10) || CASE p_partkey % 7 WHEN 3 THEN '-beta' ELSE '' END END AS version,
              p_partkey % 7 NOT IN (5, 6) AND p_size = 0 AS zero_major, p_partkey % 7 NOT IN (5, 6) AND p_size > 0 AS positive_major FROM part""",
)
def normalized_versions(x: Inputs) -> DataFrame:
    key = F.col("p_partkey") % 7
    number = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"))
    raw = (
        F.when(key == 0, F.concat(F.lit("^"), number))
        .when(key == 1, F.concat(F.lit(">= "), number, F.lit(",<99")))
        .when(key == 2, F.concat(F.lit("~="), number))
        .when(key == 3, F.concat(number, F.lit("-beta")))
        .when(key == 4, F.concat(number, F.lit(" ; python")))
        .when(key == 5, F.lit(" * "))
        .otherwise("")
    )
    rows = x.table("part").select(F.col("p_partkey").alias("id"), raw.alias("raw"))
    normal = rows.select("id", *exprs(version=versions.normalize_version("raw")))
    return normal.select(
        "*",
        *exprs(
            zero_major=versions.has_zero_major("version"),
            positive_major=versions.has_positive_major("version"),
        ),
    )


def manifest_rows(x: Inputs, file_name: str, text: Column) -> DataFrame:
    """One manifest per part row, so the number of manifests grows with the table."""
    return x.table("part").select(
        F.col("p_type").alias("repo"),
        F.lit(file_name).alias("path"),
        F.format_string("%012d/%s", "p_partkey", F.lit(file_name)).alias("file_seq"),
        F.lit(file_name).alias("file_name"),
        F.lit(m.MANIFEST_SOURCES[file_name]).alias("source"),
        text.cast("binary").alias("content"),
    )


def occurrences_in(x: Inputs, file_name: str, text: Column) -> DataFrame:
    parsed = m.parse_manifests(manifest_rows(x, file_name, text))
    return m.occurrences_of(parsed).drop("file_seq", "entry_seq")


def part_text(template: str) -> Column:
    """A text per part row; ``{name}``, ``{other}`` and ``{v}`` stand for values of the row."""
    values = {
        "{name}": F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
        "{other}": F.concat(F.lit("lib"), (F.col("p_partkey") % 50).cast("string")),
        "{v}": F.concat((F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string")),
    }
    text: Column = F.lit(template)
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    return text


PART = """SELECT p_type AS repo, replace(p_name, ' ', '-') AS name, 'lib' || (p_partkey % 50) AS other,
  (p_size % 4) || '.' || (p_partkey % 7) AS v, p_partkey AS k FROM part"""


def expected(source: str, *rows: tuple[str, str, str], where: str = "true") -> str:
    """The dependency rows each part row must yield: (name, version, type) as SQL expressions."""
    selects = [
        f"SELECT repo, {name} AS name, {version} AS version, '{source}' AS source, '{kind}' AS dep_type FROM p WHERE {where}"
        for name, version, kind in rows
    ]
    return f"WITH p AS ({PART}) " + " UNION ALL ".join(selects)


@query(
    "parse_requirements",
    expected("python", ("name", "v", "runtime"), ("other", "v", "runtime"), ("'-r base.txt'", "NULL", "runtime"), ("'pkg!'", "v", "runtime")),
)
def parse_requirements(x: Inputs) -> DataFrame:
    text = part_text("# pinned\n\n{name}=={v}\r\n   # note\n  {other} >= {v} \n-r base.txt\npkg!={v},=={v}\n".replace("pkg!={v},=={v}", "pkg! == {v}"))
    return occurrences_in(x, "requirements.txt", text)


@query(
    "parse_setup_cfg",
    expected("python", ("'name'", "name", "runtime"), ("other || '>'", "v", "runtime")),
)
def parse_setup_cfg(x: Inputs) -> DataFrame:
    return occurrences_in(x, "setup.cfg", part_text("[metadata]\nname = {name}\n[a=b]\n  {other}>={v}\nplain\n"))


@query(
    "parse_package_json",
    expected(
        "javascript",
        ("name", "v", "runtime"),
        ("'none'", "NULL", "runtime"),
        ("other", "v", "development"),
        ("'any'", "'*'", "development"),
        ("'peer-' || other", "v", "peer"),
        ("name", "v", "optional"),
        where="k % 5 NOT IN (3, 4)",
    ),
)
def parse_package_json(x: Inputs) -> DataFrame:
    good = (
        '{"name": "app", "dependencies": {"{name}": "^{v}", "none": null}, '
        '"devDependencies": {"{other}": "~={v}", "any": "*"}, '
        '"peerDependencies": {"peer-{other}": ">= {v}"}, "optionalDependencies": {"{name}": "{v}"}}'
    )
    kind = F.col("p_partkey") % 5
    text = (
        F.when(kind == 3, part_text('{"dependencies": {"{name}": {"version": "{v}"}}}'))
        .when(kind == 4, part_text('{"dependencies": ["{name}"'))
        .otherwise(part_text(good))
    )
    return occurrences_in(x, "package.json", text)


@query(
    "parse_go_mod",
    expected("go", ("'example.com/' || name", "'v' || v", "runtime"), ("other", "'v1.2'", "runtime"), ("'m/' || other", "'v' || v", "runtime")),
)
def parse_go_mod(x: Inputs) -> DataFrame:
    text = part_text(
        "module m\ngo 1.22\nrequire example.com/{name} v{v} // indirect\nrequire (\n\t{other} v1.2\n\tm/{other} v{v}\n)\nreplace a => b\n"
    )
    return occurrences_in(x, "go.mod", text)


@query(
    "parse_cargo_toml",
    expected("rust", ("name", "v", "runtime"), ("other", "v", "runtime"), ("'path-only'", "NULL", "runtime"), where="k % 4 <> 3"),
)
def parse_cargo_toml(x: Inputs) -> DataFrame:
    good = (
        '[package]\nname = "x"\n[dependencies]\n{name} = "^{v}"\n'
        '{other} = { version = "{v}", features = ["a"] }\npath-only = { path = "../p" }\n[dev-dependencies]\nt = "1"\n'
    )
    bad = F.col("p_partkey") % 4 == 3
    return occurrences_in(x, "Cargo.toml", F.when(bad, part_text("[dependencies\n{name} =")).otherwise(part_text(good)))


@query(
    "parse_composer_json",
    expected("php", ("'php'", "v", "runtime"), ("'vendor/' || name", "v", "runtime")),
)
def parse_composer_json(x: Inputs) -> DataFrame:
    text = part_text('{"require": {"php": ">={v}", "vendor/{name}": "^{v}"}, "require-dev": {"{other}": "1"}}')
    return occurrences_in(x, "composer.json", text)


@query(
    "parse_pyproject",
    f"""WITH p AS ({PART}), q AS (
        SELECT repo, k, name AS name, v AS version, 'runtime' AS dep_type FROM p UNION ALL SELECT repo, k, other, v, 'optional' FROM p
        UNION ALL SELECT repo, k, 'bare', NULL, 'optional' FROM p WHERE k % 2 = 1)
        SELECT repo, name, version, 'python' AS source, dep_type FROM q""",
)
def parse_pyproject(x: Inputs) -> DataFrame:
    tables = '[project]\nname = "x"\n[project.dependencies]\n{name} = ">={v}"\n[project.optional-dependencies]\n{other} = "{v}"\n'
    lists = '[project]\ndependencies = ["{name}>={v}"]\n[project.optional-dependencies]\ntest = ["{other}=={v}", "bare"]\n'
    text = F.when(F.col("p_partkey") % 2 == 1, part_text(lists)).otherwise(part_text(tables))
    return occurrences_in(x, "pyproject.toml", text)


@query(
    "detected_sources",
    """SELECT p_type AS repo, string_agg(DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'rust' ELSE 'jvm' END, ','
         ORDER BY CASE p_partkey % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'rust' ELSE 'jvm' END) AS sources_detected
       FROM part WHERE NOT (p_partkey % 3 = 0 AND p_size > 10) AND NOT (p_partkey % 3 = 1 AND p_type <> 'SMALL') GROUP BY p_type""",
)
def detected_sources(x: Inputs) -> DataFrame:
    package = F.when(F.col("p_size") > 10, "{bad").otherwise("{}")
    cargo = F.when(F.col("p_type") != "SMALL", "=").otherwise("[dependencies]")
    third = F.col("p_partkey") % 3

    def part(file_name: str, text: Column, key: int) -> DataFrame:
        content = F.when(third == key, text)
        return manifest_rows(x, file_name, content).where(F.col("content").isNotNull())

    rows = part("package.json", package, 0).unionByName(part("Cargo.toml", cargo, 1))
    rows = rows.unionByName(part("pom.xml", F.lit("<project/>"), 2))
    return joined(m.detected_sources(m.parse_manifests(rows)), "sources_detected")


# One manifest per part row, of the seven formats in turn. Some name a package twice: the later entry counts.
FORMATS = {
    "requirements.txt": "{name}==9.9\n{name}=={v}\n",
    "setup.cfg": "[metadata]\n{name} = {v}\n",
    "go.mod": "require {name} {v}\n",
    "package.json": '{"dependencies": {"{name}": "7.7"}, "devDependencies": {"{name}": "^{v}"}}',
    "composer.json": '{"require": {"{name}": "{v}"}}',
    "pyproject.toml": '[project]\ndependencies = ["{name}==8.8", "{name}=={v}"]\n',
    "Cargo.toml": '[dependencies]\n{name} = "{v}"\n',
}


@query(
    "repository_dependency_report",
    f"""WITH p AS ({PART}), e AS (SELECT repo, k, name, v FROM p WHERE NOT (k % 7 = 3 AND k % 10 = 9)),
        first AS (SELECT repo, lower(name) AS key, arg_min(v, k) AS v FROM e GROUP BY repo, lower(name)),
        seen AS (SELECT repo, string_agg(DISTINCT s, ',' ORDER BY s) AS sources_detected FROM (SELECT repo, CASE k % 7 WHEN 2 THEN 'go' WHEN 3 THEN 'javascript'
          WHEN 4 THEN 'php' WHEN 6 THEN 'rust' ELSE 'python' END AS s FROM e) GROUP BY repo)
        SELECT repo, count(*) AS total, count(*) FILTER (starts_with(v, '0.')) AS vulnerable,
               count(*) FILTER (starts_with(v, '0.')) AS outdated,
               greatest(0.0, round(1.0 - (count(*) FILTER (starts_with(v, '0.')) / CAST(count(*) AS DOUBLE) * 0.6e0
                 + count(*) FILTER (starts_with(v, '0.')) / CAST(count(*) AS DOUBLE) * 0.4e0), 3)) AS health_score,
               any_value(sources_detected) AS sources_detected FROM first JOIN seen USING (repo) GROUP BY repo""",
)
def repository_dependency_report(x: Inputs) -> DataFrame:
    """From file tables of all formats that are parsed; some package files are damaged."""
    kind = F.col("p_partkey") % 7
    name, text = F.lit(""), F.lit("")
    for number, (file_name, template) in enumerate(FORMATS.items()):
        name = F.when(kind == number, file_name).otherwise(name)
        text = F.when(kind == number, part_text(template)).otherwise(text)
    text = F.when((kind == 3) & (F.col("p_partkey") % 10 == 9), "{bad").otherwise(text)
    files = x.table("part").select(
        F.col("p_type").alias("repo"),
        F.concat(F.format_string("d%012d/", "p_partkey"), name).alias("path"),
        text.cast("binary").alias("content"),
        F.lit(None).cast("string").alias("error"),
    )
    report = reports.repository_dependency_report(repos_of(files), files)["summary"]
    columns = ("repo", "total", "vulnerable", "outdated", "health_score", "sources_detected")
    return joined(report.select(*columns), "sources_detected")


# Merge and enrichment

@query("merged_dependencies", "SELECT repo, name, version, source, dep_type FROM merged", "merged")
def merged_dependencies(x: Inputs) -> DataFrame:
    return d.merge_dependencies(x.occurrences).drop("ord")


@query(
    "deduplicated_dependencies",
    "SELECT repo, dep_key, name, version, source, dep_type FROM dedup",
    "dedup",
)
def deduplicated_dependencies(x: Inputs) -> DataFrame:
    return d.deduplicate(d.merge_dependencies(x.occurrences)).drop("ord")


@query(
    "dependencies",
    """SELECT repo, dep_key, name, version, source, dep_type, license, is_zero AS is_vulnerable,
              coalesce(major = 0, false) AS is_outdated,
              concat_ws(',', CASE WHEN is_alpha THEN 'PRE-' || upper(name) || '-001:medium' END,
                             CASE WHEN is_zero THEN 'ZERO-' || upper(name) || '-001:high' END) AS vulnerabilities FROM deps""",
    "deps",
)
def dependencies(x: Inputs) -> DataFrame:
    listed = F.transform("vulnerabilities", lambda v: F.concat_ws(":", v["identifier"], v["severity"]))
    return deps_of(x).drop("ord").withColumn("vulnerabilities", F.array_join(listed, ","))


@query("licenses", "SELECT repo, dep_key, license FROM deps", "deps")
def licenses(x: Inputs) -> DataFrame:
    return deps_of(x).select("repo", "dep_key", "license")


@query("outdated_count", "SELECT repo, count(*) FILTER (major = 0) AS outdated FROM deps GROUP BY repo", "deps")
def outdated_count(x: Inputs) -> DataFrame:
    return d.outdated_count(dep_repos(x), deps_of(x))


@query("vulnerable_count", "SELECT repo, count(*) FILTER (is_zero) AS vulnerable FROM deps GROUP BY repo", "deps")
def vulnerable_count(x: Inputs) -> DataFrame:
    return d.vulnerable_count(dep_repos(x), deps_of(x))


SUMMARY = """, n AS (SELECT repo, count(*) AS total, count(*) FILTER (is_zero) AS vulnerable, count(*) FILTER (major = 0) AS outdated FROM deps GROUP BY repo),
  src AS (SELECT repo, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources_detected FROM occ GROUP BY repo),
  s AS (SELECT *, greatest(0.0, round(1.0 - (vulnerable / CAST(total AS DOUBLE) * 0.6e0 + outdated / CAST(total AS DOUBLE) * 0.4e0), 3)) AS health_score
        FROM n JOIN src USING (repo)),
  summary AS (SELECT *, concat_ws(';', CASE WHEN vulnerable > 0 THEN vulnerable || ' vulnerable dependencies detected' END,
     CASE WHEN outdated > 0 THEN outdated || ' outdated dependencies detected' END,
     CASE WHEN health_score < 0.7 THEN 'Dependency health score is below recommended threshold' END) AS recommendations FROM s)
"""


@query("dependency_summary", SUMMARY + "SELECT repo, total, vulnerable, outdated, sources FROM summary", "deps")
def dependency_summary(x: Inputs) -> DataFrame:
    counts = d.dependency_summary(dep_repos(x), deps_of(x), d.sources_in(x.occurrences))
    return counts.drop("sources_detected")


@query(
    "dependency_report",
    SUMMARY + """SELECT repo, total, vulnerable, outdated, sources, sources_detected, health_score,
      CASE WHEN recommendations = '' THEN 'No major dependency issues detected' ELSE recommendations END AS recommendations FROM summary""",
    "deps",
)
def dependency_report(x: Inputs) -> DataFrame:
    report = reports.dependency_report(
        dep_repos(x), x.occurrences, d.sources_in(x.occurrences), LICENSE_RULES
    )["summary"]
    text = F.array_join("recommendations", ";")
    return joined(report.withColumn("recommendations", text), "sources_detected")


@query(
    "health_of_clean_repositories",
    """SELECT p_type AS repo, 1.0e0 AS health_score, 'No major dependency issues detected' AS recommendations FROM part GROUP BY p_type""",
)
def health_of_clean_repositories(x: Inputs) -> DataFrame:
    stable = x.occurrences.withColumn("version", F.concat(F.lit("1."), F.col("entry_seq").cast("string")))
    report = reports.dependency_report(dep_repos(x), stable, d.sources_in(stable))["summary"]
    return joined(report.select("repo", "health_score", "recommendations"), "recommendations")


# Groups

@query(
    "dependencies_by_type",
    """SELECT repo, dep_type, name FROM deps UNION ALL
       SELECT repo, t, NULL FROM dep_repos, (SELECT unnest(['runtime', 'development', 'build', 'optional', 'peer', 'unknown']) AS t)
       WHERE (repo, t) NOT IN (SELECT (repo, dep_type) FROM deps)""",
    "deps dep_repos",
)
def dependencies_by_type(x: Inputs) -> DataFrame:
    return d.dependencies_by_type(dep_repos(x), deps_of(x))


@query(
    "type_counts",
    """SELECT r.repo, t AS dep_type, count(name) AS dependencies
       FROM dep_repos r CROSS JOIN (SELECT unnest(['runtime', 'development', 'build', 'optional', 'peer', 'unknown']) AS t) u
       LEFT JOIN deps d ON d.repo = r.repo AND d.dep_type = t GROUP BY r.repo, t""",
    "deps dep_repos",
)
def type_counts(x: Inputs) -> DataFrame:
    return d.type_counts(dep_repos(x), deps_of(x))


@query("dependencies_by_source", "SELECT repo, source, name FROM deps", "deps")
def dependencies_by_source(x: Inputs) -> DataFrame:
    return d.dependencies_by_source(deps_of(x))


@query(
    "license_distribution",
    "SELECT repo, license, count(*) AS dependencies FROM deps GROUP BY repo, license",
    "deps",
)
def license_distribution(x: Inputs) -> DataFrame:
    return d.license_distribution(deps_of(x))


FRESHNESS = """CASE WHEN NOT pinned THEN 'unknown' WHEN contains(version, 'dev') OR contains(version, 'alpha') THEN 'experimental'
  WHEN is_zero THEN 'early' WHEN major >= 1 THEN 'stable' ELSE 'unknown' END"""


@query(
    "freshness_summary",
    f"SELECT repo, {FRESHNESS} AS freshness, count(*) AS dependencies FROM deps GROUP BY 1, 2",
    "deps",
)
def freshness_summary(x: Inputs) -> DataFrame:
    return d.freshness_summary(deps_of(x))


@query("freshness", f"SELECT repo, name, {FRESHNESS} AS freshness FROM deps", "deps")
def freshness(x: Inputs) -> DataFrame:
    return deps_of(x).select("repo", "name", *exprs(freshness=d.freshness()))


# Risk and policy

RISK = """least(1.0, round(CASE WHEN is_zero THEN 0.5e0 ELSE 0 END + CASE WHEN is_zero THEN 0.2e0 ELSE 0 END
  + CASE WHEN license IN ('GPL', 'Proprietary') THEN 0.2e0 ELSE 0 END - CASE WHEN dep_type = 'optional' THEN 0.1e0 ELSE 0 END, 3))"""


@query("risk_scores", f"SELECT repo, name, {RISK} AS risk_score FROM deps", "deps")
def risk_scores(x: Inputs) -> DataFrame:
    return d.with_risk(deps_of(x)).select("repo", "name", "risk_score")


@query("high_risk_nodes", f"SELECT repo, name, {RISK} AS risk_score FROM deps WHERE {RISK} >= 0.5", "deps")
def high_risk_nodes(x: Inputs) -> DataFrame:
    return d.high_risk_nodes(deps_of(x))


@query("high_risk_dependencies", "SELECT repo, name FROM deps WHERE is_zero", "deps")
def high_risk_dependencies(x: Inputs) -> DataFrame:
    return d.high_risk_dependencies(deps_of(x))


@query(
    "high_risk_at_lower_threshold",
    "SELECT repo, name FROM deps WHERE is_zero OR license IN ('GPL', 'Proprietary')",
    "deps",
)
def high_risk_at_lower_threshold(x: Inputs) -> DataFrame:
    return d.high_risk_dependencies(deps_of(x), threshold=0.2)


@query(
    "policy_violations",
    """, v AS (SELECT repo, count(*) FILTER (is_zero) AS n FROM deps GROUP BY repo)
       SELECT repo, 'vulnerable_limit' AS rule, CAST(NULL AS VARCHAR) AS name, 'Vulnerable dependencies exceed limit (' || n || ')' AS message FROM v WHERE n > 10
       UNION ALL SELECT repo, 'license', name, 'Disallowed license detected: ' || name || ' (' || license || ')' FROM deps WHERE license IN ('GPL', 'MIT')
       UNION ALL SELECT repo, 'pre_release', name, 'Pre-release dependency detected: ' || name FROM deps WHERE is_pre""",
    "deps",
)
def policy_violations(x: Inputs) -> DataFrame:
    return d.evaluate_policy(deps_of(x), max_vulnerable=10, disallowed_licenses=("GPL", "MIT"))


@query(
    "policy_allowing_pre_releases",
    """, v AS (SELECT repo, count(*) FILTER (is_zero) AS n FROM deps GROUP BY repo)
       SELECT repo, 'vulnerable_limit' AS rule, CAST(NULL AS VARCHAR) AS name, 'Vulnerable dependencies exceed limit (' || n || ')' AS message FROM v WHERE n > 0""",
    "deps",
)
def policy_allowing_pre_releases(x: Inputs) -> DataFrame:
    return d.evaluate_policy(deps_of(x), allow_pre_release=True)


# Confidence

SCOPED = """, scoped AS (SELECT repo, CASE source WHEN 'python' THEN '_' || name WHEN 'javascript' THEN '@' || name ELSE name || ':x' END AS name,
    source, pinned, is_pre, license = 'Unknown' AS unknown FROM deps),
  conf AS (SELECT repo, name, source, greatest(0.0, round(1.0e0 - CASE WHEN NOT pinned THEN 0.25e0 ELSE 0 END - CASE WHEN is_pre THEN 0.15e0 ELSE 0 END
     - CASE source WHEN 'python' THEN 0.1e0 ELSE 0.05e0 END - CASE WHEN unknown THEN 0.15e0 ELSE 0 END, 3)) AS confidence_score,
     concat_ws(',', CASE WHEN NOT pinned THEN 'missing_version' END, CASE WHEN is_pre THEN 'pre_release_version' END,
       CASE source WHEN 'python' THEN 'private_python_package' WHEN 'javascript' THEN 'scoped_package' ELSE 'multi_artifact_coordinate' END,
       CASE WHEN unknown THEN 'unknown_license' END) AS reasons FROM scoped)
"""


def scoped(x: Inputs) -> DataFrame:
    """Names with the marks the ecosystem rules look for."""
    name = (
        F.when(F.col("source") == "python", F.concat(F.lit("_"), F.col("name")))
        .when(F.col("source") == "javascript", F.concat(F.lit("@"), F.col("name")))
        .otherwise(F.concat(F.col("name"), F.lit(":x")))
    )
    return deps_of(x).withColumn("name", name)


@query("confidence", SCOPED + "SELECT repo, name, source, confidence_score, reasons FROM conf", "deps")
def confidence(x: Inputs) -> DataFrame:
    return joined(d.confidence(scoped(x)), "reasons")


@query(
    "low_confidence",
    SCOPED + "SELECT repo, name, source, confidence_score, reasons FROM conf WHERE confidence_score < 0.6",
    "deps",
)
def low_confidence(x: Inputs) -> DataFrame:
    return joined(d.low_confidence(scoped(x)), "reasons")


@query(
    "confidence_summary",
    SCOPED + """SELECT repo, round(sum(CAST(round(confidence_score * 1000) AS BIGINT)) / CAST(count(*) AS DOUBLE) / 1000, 3) AS average_confidence,
                       count(*) FILTER (confidence_score < 0.6) AS low_confidence_dependencies FROM conf GROUP BY repo""",
    "deps",
)
def confidence_summary(x: Inputs) -> DataFrame:
    return d.confidence_summary(dep_repos(x), scoped(x))


# Conflicts

@query(
    "version_conflicts",
    """SELECT repo, lower(name) AS name, count(DISTINCT version) AS n_versions FROM occ WHERE version <> '' GROUP BY 1, 2
       HAVING count(DISTINCT version) > 1""",
    "occ",
)
def version_conflicts(x: Inputs) -> DataFrame:
    return cf.version_conflicts(x.occurrences)


@query(
    "conflicting_versions",
    """SELECT DISTINCT repo, lower(name) AS name, version, n_versions FROM occ JOIN
       (SELECT repo, lower(name) AS k, count(DISTINCT version) AS n_versions FROM occ WHERE version <> '' GROUP BY 1, 2) USING (repo)
       WHERE lower(name) = k AND n_versions > 1 AND version <> ''""",
    "occ",
)
def conflicting_versions(x: Inputs) -> DataFrame:
    return cf.conflicting_versions(x.occurrences)


def _several(column: str, values: str, extra: str = "") -> str:
    return f"""SELECT repo, lower(name) AS name, string_agg(DISTINCT {column}, ',' ORDER BY {column}) AS {values}{extra} FROM occ
      GROUP BY 1, 2 HAVING count(DISTINCT {column}) > 1"""


@query("type_conflicts", _several("dep_type", "types"), "occ")
def type_conflicts(x: Inputs) -> DataFrame:
    return joined(cf.type_conflicts(x.occurrences), "types")


@query(
    "ecosystem_shadowing",
    _several("source", "sources", ", count(DISTINCT source) AS \"count\""),
    "occ",
)
def ecosystem_shadowing(x: Inputs) -> DataFrame:
    return joined(cf.ecosystem_shadowing(x.occurrences), "sources")


@query(
    "version_divergence",
    """SELECT repo, lower(name) AS name, CASE WHEN max(m) = 0 THEN 0.0e0 ELSE round((max(m) - min(m)) / CAST(max(m) AS DOUBLE), 3) END AS divergence
       FROM (SELECT repo, name, CAST(regexp_extract(version, '[0-9]+') AS BIGINT) AS m FROM occ WHERE version <> '')
       GROUP BY 1, 2 HAVING count(m) > 1""",
    "occ",
)
def version_divergence(x: Inputs) -> DataFrame:
    return cf.version_divergence(x.occurrences)


CONFLICTS = """, k AS (SELECT repo, lower(name) AS name, count(DISTINCT version) FILTER (version <> '') AS v, count(DISTINCT dep_type) AS t,
    count(DISTINCT source) AS s FROM occ GROUP BY 1, 2),
  found AS (SELECT repo, name, 'version_conflict' AS conflict_type, v AS n_values FROM k WHERE v > 1
    UNION ALL SELECT repo, name, 'dependency_type_conflict', t FROM k WHERE t > 1 UNION ALL SELECT repo, name, 'ecosystem_shadowing', s FROM k WHERE s > 1)
"""


@query("dependency_conflicts", CONFLICTS + "SELECT repo, name, conflict_type, n_values FROM found", "occ")
def dependency_conflicts(x: Inputs) -> DataFrame:
    return cf.conflicts(x.occurrences)


@query("conflict_report", CONFLICTS + "SELECT repo, count(*) AS total_conflicts FROM found GROUP BY repo", "occ")
def conflict_report(x: Inputs) -> DataFrame:
    return cf.conflict_report(dep_repos(x), x.occurrences)["summary"]


# Graph

@query(
    "graph_size",
    """SELECT a.repo, any_value(n) AS nodes, count(*) AS edges FROM deps a JOIN deps b ON a.repo = b.repo AND a.dep_type = 'runtime' AND b.dep_type <> 'runtime'
       JOIN (SELECT repo, count(*) AS n FROM deps GROUP BY repo) c ON c.repo = a.repo GROUP BY a.repo""",
    "deps",
)
def graph_size(x: Inputs) -> DataFrame:
    return g.graph_size(dep_repos(x), deps_of(x))


@query(
    "graph_nodes",
    f"""SELECT d.repo, d.name, d.dep_type, {RISK} AS risk_score,
         (SELECT count(*) FROM deps o WHERE o.repo = d.repo AND o.dep_type <> 'runtime' AND d.dep_type = 'runtime') AS dependencies,
         (SELECT count(*) FROM deps o WHERE o.repo = d.repo AND o.dep_type = 'runtime' AND d.dep_type <> 'runtime') AS dependents FROM deps d""",
    "deps",
)
def graph_nodes(x: Inputs) -> DataFrame:
    return g.graph_nodes(deps_of(x))


@query(
    "graph_leaves_and_roots",
    """SELECT repo, name, 'leaf' AS kind FROM deps WHERE dep_type <> 'runtime' UNION ALL SELECT repo, name, 'root' FROM deps WHERE dep_type = 'runtime'""",
    "deps",
)
def graph_leaves_and_roots(x: Inputs) -> DataFrame:
    nodes = g.graph_nodes(deps_of(x))
    leaves = g.leaves(nodes).withColumn("kind", F.lit("leaf"))
    return leaves.unionByName(g.roots(nodes).withColumn("kind", F.lit("root")))


@query(
    "graph_neighbours",
    """SELECT 'small-ring' AS node, name FROM deps WHERE repo = 'ECONOMY'
         AND (dep_type = 'runtime') <> (SELECT dep_type = 'runtime' FROM deps WHERE repo = 'ECONOMY' AND dep_key = 'small-ring')""",
    "deps",
)
def graph_neighbours(x: Inputs) -> DataFrame:
    named = deps_of(x).withColumn("name", F.when(F.col("dep_key") == "small-ring", F.col("dep_key")).otherwise(F.col("name")))
    below = g.dependencies_of(named, "ECONOMY", "small-ring")
    above = g.dependents_of(named, "ECONOMY", "small-ring")
    return below.unionByName(above).select(F.lit("small-ring").alias("node"), "name")


@query(
    "graph_report",
    SUMMARY + """SELECT repo, total, vulnerable, outdated, health_score, total AS nodes,
      (SELECT count(*) FILTER (dep_type = 'runtime') * count(*) FILTER (dep_type <> 'runtime') FROM deps d WHERE d.repo = summary.repo) AS edges FROM summary""",
    "deps",
)
def graph_report(x: Inputs) -> DataFrame:
    report = reports.graph_report(dep_repos(x), deps_of(x), d.sources_in(x.occurrences))["summary"]
    return report.select("repo", "total", "vulnerable", "outdated", "health_score", "nodes", "edges")


# Findings and insights

FINDINGS = """, found AS (
    SELECT repo, name, 'medium' AS severity, 'vulnerability' AS category, 'Vulnerability detected: PRE-' || upper(name) || '-001' AS message, 1 AS o,
      '{"version":"' || version || '","description":"Pre-release version detected"}' AS evidence FROM deps WHERE is_alpha
    UNION ALL SELECT repo, name, 'high', 'vulnerability', 'Vulnerability detected: ZERO-' || upper(name) || '-001', 2,
      '{"version":"' || version || '","description":"Major version zero dependency"}' FROM deps WHERE is_zero
    UNION ALL SELECT repo, name, 'medium', 'license', 'Potentially restrictive license: ' || license, 3, '{"license":"' || license || '"}' FROM deps
      WHERE license IN ('GPL', 'Proprietary')
    UNION ALL SELECT repo, name, 'medium', 'stability', 'Dependency uses major version zero', 4, '{"version":"' || version || '"}' FROM deps WHERE is_zero
    UNION ALL SELECT repo, name, 'low', 'stability', 'Pre-release dependency version detected', 5, '{"version":"' || version || '"}' FROM deps WHERE is_pre
    UNION ALL SELECT repo, name, 'info', 'classification', 'Optional dependency', 6, '{}' FROM deps WHERE dep_type = 'optional')
"""


@query(
    "dependency_findings",
    FINDINGS + """SELECT repo, name, severity, category, message, evidence,
      CAST(row_number() OVER (PARTITION BY repo, name ORDER BY o) - 1 AS INTEGER) AS position FROM found""",
    "deps",
)
def dependency_findings(x: Inputs) -> DataFrame:
    return d.findings(deps_of(x)).withColumn("evidence", F.to_json("evidence"))


@query(
    "finding_summary",
    FINDINGS + "SELECT repo, severity, count(*) AS findings FROM found GROUP BY repo, severity",
    "deps",
)
def finding_summary(x: Inputs) -> DataFrame:
    return reports.explainability_report(deps_of(x))["finding_summary"]


@query(
    "risk_explanations",
    """, r AS (SELECT repo, name, concat_ws(', ', CASE WHEN is_zero THEN 'known vulnerabilities' END, CASE WHEN is_zero THEN 'major version zero' END,
         CASE WHEN license IN ('GPL', 'Proprietary') THEN 'restrictive license' END, CASE WHEN NOT pinned THEN 'missing version pin' END) AS reasons FROM deps)
       SELECT repo, name, CASE WHEN reasons = '' THEN 'No significant risk factors identified' ELSE 'Risk due to: ' || reasons END AS explanation FROM r""",
    "deps",
)
def risk_explanations(x: Inputs) -> DataFrame:
    return reports.explainability_report(deps_of(x))["explanations"]


@query(
    "usage_profiles",
    """, t AS (SELECT *, dep_type IN ('development', 'build') AS tooling FROM deps),
       r AS (SELECT *, concat_ws(',', CASE WHEN tooling THEN 'development_or_build_dependency' END, CASE WHEN dep_type = 'runtime' THEN 'runtime_dependency' END,
         CASE WHEN is_zero THEN 'has_known_vulnerabilities' END, CASE WHEN is_zero THEN 'early_version_dependency' END,
         CASE WHEN license IN ('GPL', 'Proprietary') THEN 'restrictive_license' END) AS reasons FROM t)
       SELECT repo, name, CASE WHEN tooling THEN 'tooling' WHEN dep_type = 'runtime' THEN 'runtime' ELSE 'direct' END AS usage_type,
         CASE WHEN is_zero THEN 'high' WHEN tooling THEN 'low' ELSE 'medium' END AS criticality,
         CASE WHEN reasons = '' THEN 'no_special_risk_indicators' ELSE reasons END AS reasoning FROM r""",
    "deps",
)
def usage_profiles(x: Inputs) -> DataFrame:
    return joined(d.usage_profiles(deps_of(x)), "reasoning")


@query(
    "upgrade_impacts",
    """, t AS (SELECT *, dep_type IN ('development', 'build') AS tooling FROM deps)
       SELECT repo, name, version AS current_version, CASE WHEN NOT pinned THEN 'unknown' WHEN is_zero OR major = 0 THEN 'high' ELSE 'medium' END AS risk_level,
         CASE WHEN NOT pinned THEN 'unknown' WHEN tooling THEN 'low' ELSE 'medium' END AS estimated_effort,
         CASE WHEN NOT pinned THEN 'version_not_pinned' ELSE concat_ws(',', CASE WHEN major = 0 THEN 'unstable_major_version' ELSE 'semantic_versioning_applies' END,
           CASE WHEN is_zero THEN 'security_fix_recommended' END, CASE WHEN tooling THEN 'tooling_dependency' END) END AS notes FROM t""",
    "deps",
)
def upgrade_impacts(x: Inputs) -> DataFrame:
    return joined(d.upgrade_impacts(deps_of(x)), "notes")


@query(
    "dependency_insights",
    """SELECT repo, 'license' AS part, license AS key, count(*) AS n FROM deps GROUP BY repo, license
       UNION ALL SELECT repo, 'high_risk', 'all', count(*) FROM deps WHERE is_zero GROUP BY repo
       UNION ALL SELECT repo, 'usage', CASE WHEN dep_type = 'development' THEN 'tooling' WHEN dep_type = 'runtime' THEN 'runtime' ELSE 'direct' END, count(*)
         FROM deps GROUP BY 1, 3
       UNION ALL SELECT repo, 'upgrade', CASE WHEN NOT pinned THEN 'unknown' WHEN major = 0 THEN 'high' ELSE 'medium' END, count(*) FROM deps GROUP BY 1, 3""",
    "deps",
)
def dependency_insights(x: Inputs) -> DataFrame:
    parts = reports.insights(deps_of(x))

    def counted(df: DataFrame, part: str, key: Column) -> DataFrame:
        return df.groupBy("repo", F.lit(part).alias("part"), key.alias("key")).agg(F.count("*").alias("n"))

    licenses_ = parts["license_distribution"].select(
        "repo", F.lit("license").alias("part"), F.col("license").alias("key"), F.col("dependencies").alias("n")
    )
    return (
        licenses_.unionByName(counted(parts["high_risk_dependencies"], "high_risk", F.lit("all")))
        .unionByName(counted(parts["usage_profiles"], "usage", F.col("usage_type")))
        .unionByName(counted(parts["upgrade_impacts"], "upgrade", F.col("risk_level")))
    )

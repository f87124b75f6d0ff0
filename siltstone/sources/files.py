"""Documents from landed files: whole files, site pages, pinned files, and a folder of decision records.

The network stays outside: a landing job puts files below a folder, one folder a repository. A source that failed
is told apart from an empty one by raising; an ingest pass then never sees half a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import html
from siltstone.operators import chunking

DOCUMENT = "source_repo string, file_path string, doc_type string, text string"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, invalid ones as replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def landed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(source_repo, file_path, text) of files root/repo/path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    below = F.regexp_extract(F.col("path"), r"^(?:file:)?/*" + root.split(":", 1)[-1].strip("/").replace(".", r"\.") + r"/+(.*)$", 1)
    named = files.withColumn("rel", below)
    return named.select(F.substring_index("rel", "/", 1).alias("source_repo"), F.expr("substring(rel, locate('/', rel) + 1)").alias("file_path"), decoded(F.col("content")).alias("text"))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """The listing of repositories as it was landed: JSON lines; flags that are absent are null."""
    return spark.read.schema("name string, fork boolean, archived boolean, private boolean").json(path)


def wanted_repos(repos: DataFrame, excluded: str = "") -> DataFrame:
    """Repositories that are no forks, not archived, not private and not excluded (a comma list)."""
    names = [x.strip() for x in excluded.split(",") if x.strip()]
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    kept = repos.where(off("fork") & off("archived") & off("private"))
    return kept.where(~F.col("name").isin(names)) if names else kept


def pinned(spark: SparkSession, listed: str) -> DataFrame:
    """(source_repo, file_path, doc_type) of a comma list repo:path:doc_type; a malformed entry raises."""
    rows = [tuple(x.strip().split(":", 2)) for x in listed.split(",") if x.strip()]
    if bad := [r for r in rows if len(r) != 3]:
        raise ValueError(f"not repo:path:doc_type: {':'.join(bad[0])}")
    return spark.createDataFrame(rows, "source_repo string, file_path string, doc_type string")


def site_pages(files: DataFrame, repo: str, prefix: str, doc_type: str) -> DataFrame:
    """Pages of a site below a prefix, as text."""
    pages = files.where((F.col("source_repo") == repo) & F.col("file_path").startswith(prefix) & F.col("file_path").endswith(".html"))
    return pages.select("source_repo", "file_path", F.lit(doc_type).alias("doc_type"), html.html_to_text("text").alias("text"))


def readmes(files: DataFrame, repos: DataFrame) -> DataFrame:
    found = files.where(F.col("file_path") == "README.md").join(repos.select(F.col("name").alias("source_repo")), "source_repo", "left_semi")
    return found.select("source_repo", "file_path", F.lit("readme").alias("doc_type"), "text")


def record_folder(files: DataFrame, repo: str, prefix: str) -> DataFrame:
    """Valid decision records of a folder: Markdown but no template or readme, the file named by its id or its slug, each
    id once, the first file by name. Malformed ones drop out on their own."""
    inside = files.where((F.col("source_repo") == repo) & F.col("file_path").startswith(prefix.strip("/") + "/"))
    name = F.substring(F.col("file_path"), len(prefix.strip("/")) + 2, 10_000)
    named = inside.withColumn("name", name).where(~F.col("name").contains("/") & F.col("name").endswith(".md") & ~F.col("name").isin("TEMPLATE.md", "README.md"))
    parsed = chunking.records(named).where(F.col("error").isNull()).select("file_path", "adr_id", "slug")
    stem = F.regexp_replace("name", r"\.md$", "")
    met = named.join(parsed, "file_path").where((stem == F.col("adr_id")) | stem.startswith(F.concat("adr_id", F.lit("-"))) | F.coalesce(stem == F.col("slug"), F.lit(False)))
    once = met.groupBy("adr_id").agg(F.min_by(F.struct("source_repo", "file_path", "text"), "name").alias("r")).select("r.*")
    return once.select("source_repo", "file_path", F.lit("adr").alias("doc_type"), "text")


def listed_records(listing: DataFrame, texts: DataFrame, repo: str, prefix: str, host: str) -> DataFrame:
    """Decision records of a folder's ``listing`` (name, type, download_url), with the ``texts`` (name, text) that were
    fetched: all or nothing. If a record has no address on ``host`` by https, or no text was fetched for it, none comes
    out, so that a partial set never replaces a whole one; a malformed record only drops out itself."""
    wanted = listing.where((F.col("type") == "file") & F.col("name").endswith(".md") & ~F.col("name").isin("TEMPLATE.md", "README.md"))
    met = wanted.join(texts.select("name", "text"), "name", "left")
    sound = F.coalesce(F.col("download_url").startswith(f"https://{host}/"), F.lit(False)) & F.col("text").isNotNull()
    whole = met.agg(F.count_if(~sound).alias("faults")).where("faults = 0")
    rows = met.join(F.broadcast(whole)).select(F.lit(repo).alias("source_repo"), F.concat(F.lit(prefix.strip("/") + "/"), "name").alias("file_path"), "text")  # one row or none
    return record_folder(rows, repo, prefix)


def gather(*parts: DataFrame) -> DataFrame:
    """All sources, in order: ``source_order`` decides which of two rows of one document is the later."""
    out = None
    for i, p in enumerate(parts):
        part = p.select("source_repo", "file_path", "doc_type", "text", F.lit(i).alias("source_order"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("text").isNotNull() & (F.col("text") != ""))

"""Collections of variants: site and genotype tables with what was read from where, and region search.

A collection is a folder: ``sites`` and ``genotypes`` are Parquet tables partitioned by source (and
sample). Both are cut into the same buckets by ranges of the linear position and ordered by it inside a file, so that a region becomes
a list of buckets and a range on ``lin`` and ``key`` that Parquet's statistics answer, and a sample's genotypes meet their sites bucket by
bucket without a shuffle. Keys are 16 bytes, which Parquet compares without sign. ``meta`` has a version per change.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.functions import catalogue

from locuskey.functions.assembly import NAME_INDEX, parse_assembly_name
from locuskey.functions.ids import dashed, key_of, region_bounds
from locuskey.sources.vcf import genotypes, info_json, read_header, read_lines, variants

META = "table_name string, table_type string, source_file string, sample_name string, vcf_header string, info_definitions string, format_definitions string, contigs string, added_at timestamp"
SITES = "key binary, lin long, bin int, asm tinyint, qual float, filter string, info string, multiallelic boolean, source string"
GENOTYPES = "key binary, lin long, bin int, asm tinyint, allele1 int, allele2 int, phased boolean, dp int, gq int, format_extra string, source string, sample string"
#: A range of positions that lies in one bucket: 2**22 bases, so that a genome has under 800.
BIN_BITS = 22
#: Files of a bucket in one addition: a range that has many rows is written by several tasks.
FILES = 2


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: an aggregate, so that a task passes one row per key on."""
    rest = [c for c in rows.columns if c not in keys]
    # The last key varies most: rows are sorted by its first bytes, not by those of a name that all have.
    best = rows.groupBy(*reversed(keys)).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col("_best").getField(c).alias(c) for c in rows.columns])


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` to be appended: the first of each key that ``existing`` does not have."""
    return first_of_each(new, keys, order).join(existing.select(*keys), keys[::-1], "left_anti").select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same keys."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def in_region(rows: DataFrame, low_key: str, high_key: str, low: int, high: int) -> DataFrame:
    """Key range, and the same range on ``lin`` for the scan to skip row groups by, and on ``bin``, where rows have it, to skip buckets by."""
    ends = (low_key, high_key)
    if isinstance(rows.schema["key"].dataType, T.BinaryType):
        ends = tuple(F.lit(bytes.fromhex(x)) for x in ends)
    found = rows.where(F.col("lin").between(low, high) & F.col("key").between(*ends))
    return found.where(F.col("bin").isin(list(range(low >> BIN_BITS, (high >> BIN_BITS) + 1)))) if "bin" in rows.columns else found


def search_sites(sites: DataFrame, bounds: tuple[str, str, int, int]) -> DataFrame:
    """Sites of a region in genomic order."""
    return in_region(sites, *bounds).orderBy("key")


def search_genotypes(calls: DataFrame, sites: DataFrame, bounds: tuple[str, str, int, int]) -> DataFrame:
    """A sample's genotypes in a region with their sites, in genomic order; the range is put on both sides of the join."""
    on = ["source", *(["bin"] if "bin" in calls.columns and "bin" in sites.columns else []), "key"]
    s = in_region(sites, *bounds).select(*on, "qual", "filter", "info", "multiallelic")
    return in_region(calls, *bounds).join(s, on, "left").orderBy("key")


class Collection:
    """A folder of variant tables; ``buckets``, of a new one, is how many parts positions are dealt into."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs_path = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._fs_path)
        self.path = self._fs.makeQualified(self._fs_path).toString()
        self.buckets = self._layout(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        # Buckets by a part of the join's keys are as good as by all of them: every join here has further keys.
        self._joining = spark.newSession()
        self._joining.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self._joining.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        self._known: set[str] = set()

    def _layout(self, buckets: int) -> int:
        """How many buckets the tables have: as was written once, or as is wanted."""
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout.json")
        if self._fs.exists(p):
            stream = self._fs.open(p)
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["buckets"]
            finally:
                stream.close()
        stream = self._fs.create(p, False)
        try:
            stream.write(bytearray(json.dumps({"buckets": buckets, "bin_bits": BIN_BITS}).encode()))
        finally:
            stream.close()
        return buckets

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def _catalogued(self, name: str, schema: str, parts: list[str]) -> str:
        """The name under which the session's catalogue knows a table of this folder."""
        table = f"locuskey_{hashlib.md5(self.path.encode()).hexdigest()}_{name}"
        if table not in self._known:
            self._fs.mkdirs(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet PARTITIONED BY ({', '.join(parts)}) CLUSTERED BY (bin) SORTED BY (lin, key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.spark.sql(f"MSCK REPAIR TABLE {table}")
            self._known.add(table)
        return table

    @property
    def sites(self) -> DataFrame:
        return self.spark.table(self._catalogued("sites", SITES, ["source"]))

    @property
    def genotypes(self) -> DataFrame:
        return self.spark.table(self._catalogued("genotypes", GENOTYPES, ["source", "sample"]))

    def _versions(self) -> list[int]:
        if not self._there("meta"):
            return []
        found = self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta"))
        names = [(x.getPath().getName(), x.getPath().toString()) for x in found]
        return sorted(int(n[2:]) for n, p in names if n.startswith("v=") and self._there(f"meta/{n}/_SUCCESS"))

    @property
    def meta(self) -> DataFrame:
        """The newest complete version."""
        versions = self._versions()
        return self.spark.read.schema(META).parquet(f"{self.path}/meta/v={versions[-1]}") if versions else self.spark.createDataFrame([], META)

    def add_vcf(self, source: str, assembly: str = "GRCh38") -> str:
        """Adds a VCF file's sites and genotypes under the prefix of its name, which is returned.

        What a key already has stays (the first row in file order, too); tables come before ``meta``,
        so an addition that broke off is not listed and can be repeated.
        """
        code = parse_assembly_name(assembly)
        header, zipped = read_header(self.spark, source)
        prefix = prefix_of(source)
        types = header.types
        # Worked out for either table: that costs less than to keep every record's fields and read them twice.
        found = variants(read_lines(self.spark, source, zipped), header.scheme(), code)
        order = ["block", "row", "allele"]
        new = found.select("key", "lin", "asm", "qual", "filter", info_json(F.col("info"), types["INFO"]).alias("info"), "multiallelic", *order).withColumn("source", F.lit(prefix))
        self.add_sites(new, order, prefix)
        if header.samples:
            calls = genotypes(found, header.samples, types["FORMAT"]).withColumn("source", F.lit(prefix))
            self._append(self.genotypes.where(F.col("source") == prefix), calls, ["source", "sample", "key"], order)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        common = (header.text, *(header.definitions_json(k) for k in ("INFO", "FORMAT", "contig")), now)
        rows = [(f"{prefix}__sites", "sites", source, None, *common)] + [(f"{prefix}__{s}", "sample", source, s, *common) for s in header.samples]
        versions = self._versions()
        upsert(self.meta, self.spark.createDataFrame(rows, META), ["table_name"]).coalesce(1).write.parquet(f"{self.path}/meta/v={(versions or [0])[-1] + 1}")
        return prefix

    def add_sites(self, rows: DataFrame, order: list[str], source: str | None = None) -> None:
        """Adds sites, of one source if it is given; ``rows`` has the columns of ``sites`` but ``bin``, keys in hex, and those of ``order``, by which the first of a source's key is taken."""
        self._append(self.sites if source is None else self.sites.where(F.col("source") == source), rows, ["source", "key"], order)

    def add_calls(self, rows: DataFrame, order: list[str]) -> None:
        """Adds genotypes; ``rows`` has the columns of ``genotypes`` but ``bin``, keys in hex, and those of ``order``, by which the first of a sample's key is taken."""
        self._append(self.genotypes, rows, ["source", "sample", "key"], order)

    def _append(self, there: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> None:
        """Appends to the table of ``keys`` what ``there`` has not; a bucket's rows go to FILES tasks, which write nothing else."""
        name, schema, parts = ("genotypes", GENOTYPES, keys[:-1]) if "sample" in keys else ("sites", SITES, keys[:-1])
        new = rows.withColumns({"key": F.unhex("key"), "bin": F.shiftright("lin", BIN_BITS).cast("int")})
        fresh = insert_or_ignore(there, new, keys, order).select(*there.columns)
        # As buckets are numbered, so that a task's rows are one bucket's.
        number = F.pmod(F.hash("bin"), F.lit(self.buckets)) * FILES + F.pmod(F.col("lin"), F.lit(FILES)).cast("int")
        dealt = fresh.repartitionById(self.buckets * FILES, number)
        dealt.write.insertInto(self._catalogued(name, schema, parts))

    def list_samples(self) -> list[str]:
        """Names of the genotype tables, in order."""
        return [r[0] for r in self.meta.where("table_type = 'sample'").select("table_name").orderBy("table_name").collect()]

    def list_sources(self) -> list[str]:
        return [r[0] for r in self.meta.select("source_file").distinct().orderBy("source_file").collect()]

    def search_region(self, table: str, chrom: str, start: int, end: int, assembly: str = "GRCh38") -> DataFrame:
        """Rows of a table in a region, both ends included: ``<prefix>__sites``, or ``<prefix>__<sample>`` with its sites."""
        code = parse_assembly_name(assembly)
        bare = chrom.removeprefix("chr")
        index = NAME_INDEX.get(bare, NAME_INDEX.get(chrom.lower().removeprefix("chr")))
        if index is None:
            raise ValueError(f"unknown chromosome: {chrom}")
        known = self.meta.where(F.col("table_name") == table).select("table_type", "source_file", "sample_name").first()
        if known is None:
            raise OSError(f"no table {table}")
        try:
            bounds = region_bounds(index, start, end, code)
        except ValueError as e:
            raise OSError(str(e)) from e
        prefix = prefix_of(known.source_file)
        hits = search_sites(self.sites.where(F.col("source") == prefix), bounds) if known.table_type == "sites" else self.search_sample(prefix, known.sample_name, bounds)
        return hits.withColumn("variant_id", dashed(key_of("key")))

    def search_sample(self, source: str, sample: str, bounds: tuple[str, str, int, int]) -> DataFrame:
        """A sample's genotypes in a region with their sites, in genomic order: bucket by bucket, without a shuffle before the join."""
        table = lambda name, schema, parts: self._joining.table(self._catalogued(name, schema, parts)).where(F.col("source") == source)
        calls = table("genotypes", GENOTYPES, ["source", "sample"]).where(F.col("sample") == sample)
        return search_genotypes(calls, table("sites", SITES, ["source"]), bounds)

    def sql(self, query: str) -> DataFrame:
        """Spark SQL over the views sites, genotypes and meta, with the functions of ``functions.catalogue``."""
        if not self.spark.catalog.functionExists("hgvs_of"):
            catalogue.register(self.spark)
        self.sites.createOrReplaceTempView("sites")
        self.genotypes.createOrReplaceTempView("genotypes")
        self.meta.createOrReplaceTempView("meta")
        return self.spark.sql(query)


def prefix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return next((name.removesuffix(x) for x in (".vcf.gz", ".vcf", ".bcf", ".gz") if name.endswith(x)), name)



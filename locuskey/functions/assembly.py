"""Assemblies, contigs and the linear coordinate, as Column functions.

A chromosome index is 0..24 for 1..22, X, Y, M. An assembly code is 0 for GRCh37, 1 for GRCh38.
"""

from __future__ import annotations

from enum import Enum
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Contig lengths and RefSeq versions of the two assemblies, chromosomes 1 to 22, X, Y, M.
LENGTHS = {
    "GRCh37": [
        249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878,
        107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566, 16569,
    ],
    "GRCh38": [
        248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309, 114364328,
        107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415, 16569,
    ],
}
REFSEQ_VERSIONS = {
    "GRCh37": [10, 11, 11, 11, 9, 11, 13, 10, 11, 10, 9, 11, 10, 8, 9, 9, 10, 9, 9, 10, 8, 10, 10, 9],
    "GRCh38": [11, 12, 12, 12, 10, 12, 14, 11, 12, 11, 10, 12, 11, 9, 10, 10, 11, 10, 10, 11, 9, 11, 11, 10],
}
MITOCHONDRION = "NC_012920.1"
FIRST_GENBANK = 663
GENBANK_VERSION = {"GRCh37": 1, "GRCh38": 2}

ASSEMBLIES = ["GRCh37", "GRCh38"]
ALIASES = {"grch37": 0, "hg19": 0, "37": 0, "grch38": 1, "hg38": 1, "38": 1}
NAMES = [*map(str, range(1, 23)), "X", "Y", "M"]
UCSC_NAMES = [f"chr{x}" for x in NAMES]
REFSEQ = {a: [f"NC_{i:06d}.{v}" for i, v in enumerate(REFSEQ_VERSIONS[a], 1)] + [MITOCHONDRION] for a in ASSEMBLIES}
GENBANK = {a: [f"CM{FIRST_GENBANK + i:06d}.{GENBANK_VERSION[a]}" for i in range(24)] + [None] for a in ASSEMBLIES}
#: Linear position of the base before each contig: running sums of the lengths.
OFFSETS = {a: [0, *accumulate(LENGTHS[a])][:25] for a in ASSEMBLIES}
#: Names that resolve to an index once a leading ``chr`` is off.
NAME_INDEX = {n: i for i, n in enumerate(NAMES)} | {"x": 22, "y": 23, "m": 24, "MT": 24, "mt": 24}


class Scheme(Enum):
    BARE = "Bare"
    UCSC = "Ucsc"
    REFSEQ = "RefSeq"
    GENBANK = "GenBank"


class AssemblyNotDetectedError(ValueError):
    """No assembly was given and the header names none."""


def parse_assembly_name(name: str) -> int:
    code = ALIASES.get(name.lower())
    if code is None:
        raise ValueError(f"unknown assembly: {name}")
    return code


def contigs(spark: SparkSession) -> DataFrame:
    """The contigs of both assemblies: 50 rows."""
    rows = [(a, i, NAMES[i], UCSC_NAMES[i], LENGTHS[a][i], OFFSETS[a][i], REFSEQ[a][i], GENBANK[a][i]) for a in ASSEMBLIES for i in range(25)]
    return spark.createDataFrame(rows, "assembly string, chr_index int, name string, ucsc string, length long, linear_offset long, refseq string, genbank string")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _literal(x) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}L" if x >= 1 << 31 else str(x)


def _map(pairs: dict) -> Column:
    """A constant map, built in one call."""
    return F.expr("map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in pairs.items()) + ")")


def _array(values: list) -> Column:
    return F.expr("array(" + ", ".join(map(_literal, values)) + ")")


def _at(values: list, index: Column) -> Column:
    """values[index]; null outside."""
    return F.get(_array(values), index.cast("int"))


def parse_assembly(name) -> Column:
    """Assembly code of an alias, in any case; null if unknown."""
    return F.element_at(_map(ALIASES), F.lower(_col(name))).cast("int")


def assembly_name(code) -> Column:
    return _at(ASSEMBLIES, _col(code))


def chrom_index(name) -> Column:
    """Index of a name after one lower-case ``chr`` is taken off; null if unknown."""
    n = _col(name)
    bare = F.when(n.startswith("chr"), F.substring(n, 4, 1 << 30)).otherwise(n)
    return F.element_at(_map(NAME_INDEX), bare).cast("int")


def chrom_name(index) -> Column:
    return _at(NAMES, _col(index))


def ucsc_name(index) -> Column:
    return _at(UCSC_NAMES, _col(index))


def _by_assembly(code: Column, table: dict[str, list], index: Column) -> Column:
    """table[assembly][index]: each argument is evaluated once."""
    rows = ", ".join("array(" + ", ".join(map(_literal, table[a])) + ")" for a in ASSEMBLIES)
    return F.get(F.get(F.expr(f"array({rows})"), code.cast("int")), index.cast("int"))


def _index_of(accession: Column, code: Column, table: dict[str, list]) -> Column:
    maps = ", ".join("map(" + ", ".join(f"'{x}', {i}" for i, x in enumerate(table[a]) if x) + ")" for a in ASSEMBLIES)
    return F.element_at(F.get(F.expr(f"array({maps})"), code.cast("int")), accession).cast("int")


def refseq_index(accession, code) -> Column:
    return _index_of(_col(accession), _col(code), REFSEQ)


def genbank_index(accession, code) -> Column:
    return _index_of(_col(accession), _col(code), GENBANK)


def refseq_accession(index, code) -> Column:
    return _by_assembly(_col(code), REFSEQ, _col(index))


def classify_contig(name) -> Column:
    """The naming scheme a contig's name belongs to, whatever its case."""
    up = F.upper(_col(name))
    return (
        F.when(up.startswith("NC_"), Scheme.REFSEQ.value)
        .when(up.rlike("^CM[0-9]"), Scheme.GENBANK.value)
        .when(up.startswith("CHR"), Scheme.UCSC.value)
        .when(up.isNotNull(), Scheme.BARE.value)
    )


def resolve_contig(name, scheme, code) -> Column:
    """Index of a contig under a naming scheme: as it stands, else case-folded (names lower, accessions upper)."""
    n, c = _col(name), _col(code)
    by_name = F.coalesce(chrom_index(n), chrom_index(F.lower(n)))
    by_refseq = F.coalesce(refseq_index(n, c), refseq_index(F.upper(n), c))
    by_genbank = F.coalesce(genbank_index(n, c), genbank_index(F.upper(n), c))
    if not isinstance(scheme, Column):
        return {Scheme.REFSEQ: by_refseq, Scheme.GENBANK: by_genbank}.get(Scheme(scheme), by_name)
    return F.when(scheme == Scheme.REFSEQ.value, by_refseq).when(scheme == Scheme.GENBANK.value, by_genbank).otherwise(by_name)


def classify_name(name: str) -> Scheme:
    up = name.upper()
    if up.startswith("NC_"):
        return Scheme.REFSEQ
    if up.startswith("CM") and up[2:3].isdigit() and up[2:3].isascii():
        return Scheme.GENBANK
    return Scheme.UCSC if up.startswith("CHR") else Scheme.BARE


def detect_scheme(names: list[str]) -> Scheme:
    """The first accession's scheme; else UCSC if any name has it; else bare."""
    kinds = [classify_name(n) for n in names]
    accession = next((k for k in kinds if k in (Scheme.REFSEQ, Scheme.GENBANK)), None)
    return accession or (Scheme.UCSC if Scheme.UCSC in kinds else Scheme.BARE)


def contig_length(index, code) -> Column:
    return _by_assembly(_col(code), LENGTHS, _col(index)).cast("long")


def valid_position(index, pos, code) -> Column:
    """Whether 1 <= pos <= the contig's length; false for an unknown contig or a null."""
    return F.coalesce(_col(pos).between(F.lit(1), contig_length(index, code)), F.lit(False))


def linear_position(index, pos, code) -> Column:
    """Position in the concatenated genome; null where the position is invalid."""
    return F.when(valid_position(index, pos, code), linear_offset(index, code) + _col(pos).cast("long"))


_GENOME = {a: OFFSETS[a][24] + LENGTHS[a][24] for a in ASSEMBLIES}


def linear_index(linear, code) -> Column:
    """Contig index of a linear position: the last contig that begins before it; null outside the genome."""
    x, c = _col(linear), _col(code)
    rows = ", ".join("array(" + ", ".join(f"{v}L" for v in OFFSETS[a]) + ")" for a in ASSEMBLIES)
    before = F.size(F.filter(F.get(F.expr(f"array({rows})"), c.cast("int")), lambda o: o < x))
    end = F.get(F.expr(f"array({', '.join(f'{_GENOME[a]}L' for a in ASSEMBLIES)})"), c.cast("int"))
    return F.when(x.between(F.lit(1), end), before - 1)


def linear_offset(index, code) -> Column:
    return _by_assembly(_col(code), OFFSETS, _col(index)).cast("long")


def delinearise_join(rows: DataFrame, linear: str = "linear", assembly: str = "assembly") -> DataFrame:
    """``rows`` with chr_index and pos by an interval join with the contigs; rows outside the genome get nulls.

    The 50 contigs are a table of fixed size, so they are broadcast.
    """
    c = F.broadcast(contigs(rows.sparkSession).select(F.col("assembly").alias("_a"), "chr_index", F.col("linear_offset").alias("_o"), F.col("length").alias("_l")))
    on = (F.col(assembly) == F.col("_a")) & (F.col(linear) > F.col("_o")) & (F.col(linear) <= F.col("_o") + F.col("_l"))
    return rows.join(c, on, "left").withColumn("pos", F.col(linear) - F.col("_o")).drop("_a", "_o", "_l")


def detect_assembly(lines: list[str]) -> int | None:
    """Assembly code by the first of the header's lines ``##reference=``, ``##assembly=`` or ``##contig=<..assembly=..>`` that names one."""
    for line in lines:
        value = None
        if line.startswith(("##reference=", "##assembly=")):
            value = line.split("=", 1)[1]
        elif line.startswith("##contig="):
            value = next((p.split("=", 1)[1] for p in line[len("##contig=") :].strip("<>").split(",") if p.startswith("assembly=")), None)
        if value is not None:
            low = value.lower()
            if "grch38" in low or "hg38" in low:
                return 1
            if "grch37" in low or "hg19" in low:
                return 0
    return None

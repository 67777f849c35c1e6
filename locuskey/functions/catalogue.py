"""The codec and HGVS notation as functions of Spark SQL.

Their bodies are SQL, written out from the Column functions, so that the optimizer sees plain expressions: no Python runs, constants fold and
filters on arguments move. A function's parameters are worked out once; what a body needs several times is the parameter of a further
function. A filter on a result takes all that is below with it, once for each use; in the longer bodies, those of HGVS, each step is therefore
the argument of a lambda, which nothing is moved into.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from locuskey.functions import alleles, assembly, hgvs, ids

DECODED = "STRUCT<chr STRING, pos BIGINT, ref STRING, alt STRING, ref_len INT, alt_len INT, ref_is_exact BOOLEAN, alt_is_exact BOOLEAN, ref_fingerprint INT, alt_fingerprint INT, assembly STRING>"
NOTATION = "STRUCT<accession STRING, coord STRING, start BIGINT, end BIGINT, edit STRING, del_seq STRING, ins_seq STRING, error STRING>"

#: What a Column's text has as ``op(a, b)``: SQL knows these as functions only between backticks.
_OPERATORS = re.compile(r"(?<![\w`.])(<=>|>=|<=|!=|<>|==|=|<|>|\||&|\^|\+|-|\*|/|%|~|!|and|or|not|in)\(")


def sql_of(column: Column) -> str:
    """A Column as an SQL expression."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", column._jc.node().sql())
    return "".join(p if i % 2 else _OPERATORS.sub(r"`\1`(", p) for i, p in enumerate(parts))


@dataclass(frozen=True)
class Function:
    """An SQL function: ``body`` takes a Column for each parameter; ``calls`` are functions that its body uses."""

    name: str
    parameters: str
    returns: str
    body: object
    comment: str

    def ddl(self, temporary: bool) -> str:
        names = [p.split()[0] for p in re.split(", (?![^<]*>)", self.parameters)]
        kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
        return f"CREATE OR REPLACE {kind} {self.name}({self.parameters}) RETURNS {self.returns} COMMENT '{self.comment}' RETURN {sql_of(self.body(*map(F.col, names)))}"


def _call(name: str):
    return lambda *args: F.call_function(name, *args)


def _index(name: Column) -> Column:
    return F.coalesce(assembly.chrom_index(name), assembly.chrom_index(F.lower(name)))


def _bound(which: int):
    def body(chrom: Column, start: Column, end: Column, name: Column) -> Column:
        return ids.region_bounds_cols(_call("contig_index")(chrom), start, end, assembly.parse_assembly(name))[which]

    return body


def _key_of_notation(text: Column) -> Column:
    """GRCh38 where both assemblies have an accession."""
    known = lambda v, code: assembly.refseq_index(v.getField("accession"), F.lit(code)).isNotNull()

    def key(v: Column, code: Column) -> Column:
        place = F.struct(hgvs.to_variant(v).alias("x"), assembly.refseq_index(v.getField("accession"), code).alias("index"))
        return hgvs._let(place, lambda p: ids.encode_key(p["index"], *(p["x"][c] for c in ("pos", "ref", "alt")), code))

    return hgvs._let(hgvs.parse(text), lambda v: hgvs._let(F.when(known(v, 1), 1).when(known(v, 0), 0), lambda code: key(v, code)))


def _notation_of_key(key: Column) -> Column:
    def coded(w: Column) -> Column:
        code, r, a = ids.decoded_parts(w["w1"], w["w2"], w["w3"])
        return F.struct(w["w0"].alias("linear"), code.alias("code"), r.alias("r"), a.alias("a"))

    def spelled(p: Column) -> Column:
        index = assembly.linear_index(p["linear"], p["code"])
        return F.struct(index.alias("index"), p["linear"].alias("linear"), p["code"].alias("code"), alleles.allele_bases(p["r"]).alias("ref"), alleles.allele_bases(p["a"]).alias("alt"), alleles.is_exact(p["r"]).alias("exact"))

    def notation(p: Column) -> Column:
        coord = F.when(assembly.chrom_name(p["index"]) == "M", "m").otherwise("g")
        return hgvs.from_alleles(assembly.refseq_accession(p["index"], p["code"]), coord, p["linear"] - assembly.linear_offset(p["index"], p["code"]), p["ref"], p["alt"], p["exact"])

    words = F.struct(*(w.alias(f"w{i}") for i, w in enumerate(ids._words(key))))
    return hgvs._let(words, lambda w: hgvs._let(coded(w), lambda c: hgvs._let(spelled(c), lambda p: hgvs._let(notation(p), hgvs.render))))


#: In an order in which each uses only those before it.
FUNCTIONS = [
    Function("contig_index", "name STRING", "INT", _index, "Index of a contig name, with or without chr; null if unknown"),
    Function("assembly_code", "name STRING", "INT", assembly.parse_assembly, "Code of an assembly alias; null if unknown"),
    Function("allele_code", "seq STRING", "BIGINT", alleles.encode_allele, "46-bit code of an allele"),
    Function("sequence_fingerprint", "seq STRING", "BIGINT", alleles.fingerprint, "17-bit fingerprint of bases"),
    Function("reverse_complement", "seq STRING", "STRING", alleles.reverse_complement, "Upper-case reverse complement; N for other letters"),
    Function("variant_composed", "linear BIGINT, code INT, ref_slot BIGINT, alt_slot BIGINT", "STRING", ids.compose_key, "Key of the parts of an identifier"),
    Function("variant_placed", "index INT, pos BIGINT, ref STRING, alt STRING, code INT", "STRING", lambda i, p, r, a, c: _call("variant_composed")(assembly.linear_position(i, p, c), c, alleles.encode_slot(r), alleles.encode_slot(a)), "Key of a variant on a contig given by its index"),
    Function("variant_key", "chrom STRING, pos BIGINT, ref STRING, alt STRING, assembly STRING", "STRING", lambda n, p, r, a, c: _call("variant_placed")(_call("contig_index")(n), p, r, a, assembly.parse_assembly(c)), "32 hex digits of a variant; null where contig, position or assembly is invalid"),
    Function("variant_dashed", "key STRING", "STRING", ids.dashed, "8-8-8-8 form of a key"),
    Function("variant_parse", "text STRING", "STRING", ids.parse_key, "Key of a lenient text form; null if it has no or too many digits"),
    Function("variant_digest", "digest STRING", "STRING", ids.uuid5_of, "Version-5 UUID that begins with a digest"),
    Function("variant_uuid", "key STRING", "STRING", lambda k: _call("variant_digest")(ids.name_digest(k)), "Version-5 UUID of a key"),
    Function("variant_linear", "key STRING", "BIGINT", ids.linear_of, "Linear position of a key"),
    Function("variant_fields", "linear BIGINT, index INT, code INT, ref_code BIGINT, alt_code BIGINT", DECODED, ids.decoded_fields, "Fields of the parts of an identifier"),
    Function("variant_codes", "linear BIGINT, code INT, ref_code BIGINT, alt_code BIGINT", DECODED, lambda x, c, r, a: _call("variant_fields")(x, assembly.linear_index(x, c), c, r, a), "Fields of an identifier with its contig looked up"),
    Function("variant_words", "w0 BIGINT, w1 BIGINT, w2 BIGINT, w3 BIGINT", DECODED, lambda w0, *w: _call("variant_codes")(w0, *ids.decoded_parts(*w)), "Fields of an identifier of four words"),
    Function("variant_decode", "key STRING", DECODED, lambda k: _call("variant_words")(*ids._words(k)), "Fields of a key; null if its assembly or position is invalid"),
    Function("region_low", "chrom STRING, first BIGINT, last BIGINT, assembly STRING", "STRING", _bound(0), "Lowest key of a region; null if an end is not on the contig"),
    Function("region_high", "chrom STRING, first BIGINT, last BIGINT, assembly STRING", "STRING", _bound(1), "Highest key of a region; null if an end is not on the contig"),
    Function("hgvs_parse", "text STRING", NOTATION, hgvs.parse, "Parts of an HGVS notation, or its error"),
    Function("hgvs_key", "text STRING", "STRING", _key_of_notation, "Key of a notation that spells its bases; null if it needs a reference or is invalid"),
    Function("hgvs_of", "key STRING", "STRING", _notation_of_key, "HGVS notation of a key, without duplications and inversions; null if it cannot be decoded"),
]


def register(spark: SparkSession, temporary: bool = True) -> list[str]:
    """Makes the functions known to a session's SQL, or stores them in its current database; their names are returned. Repeating it replaces them."""
    for f in FUNCTIONS:
        spark.sql(f.ddl(temporary))
    return [f.name for f in FUNCTIONS]

"""Normalisation of variants: trim common ends, then shift indels as far left as the reference allows.

After trimming, an indel whose longer allele S of m bases stands after the reference U is shifted by
the least k >= 1 at which base k of U from its end differs from the base m - 1 further on in U + S. So S is compared with the m - 1 bases
before it, and, where these are equal, the reference with itself at the distance m - 1: a shift goes on as far as a run of that period.

Nearly all shifts end inside a window of reference before the variant. For the others the run is looked up in a table made for the periods asked for: for
each chunk of a contig the last place at which the reference differs from itself at that distance, and for each chunk the last such place in
those before it. A run over any number of chunks is one look-up, so there are no rounds and the whole is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuskey.functions.assembly import _col
from locuskey.functions.hgvs import _let
from locuskey.sources.refgenome import CHUNK, with_bases, with_long_bases
from locuskey.sources.vcf import once

#: Reference bases looked at before a variant.
WINDOW = 48
#: What norm_error can be.
NO_CONTIG, OUT_OF_BOUNDS, NO_BASES = "contig not in the reference", "position outside the contig", "no reference bases"


def skipped(ref, alt) -> Column:
    """Alleles that are left alone: empty, missing, overlapping, symbolic or breakend."""
    odd = r"^$|^\.$|^\*$|^<|[\[\]]"
    return F.coalesce(_col(ref), F.lit("")).rlike(odd) | F.coalesce(_col(alt), F.lit("")).rlike(odd)


def _alike(a: Column, b: Column, most: Column, end: bool, bits: int = 31) -> Column:
    """How many bases two texts have in common at their ends or starts, ``most`` at most: found by halving."""
    part = F.right if end else F.left
    one = F.lit(1)

    def step(found: Column, size: Column) -> Column:
        wider = found + size
        return F.when((wider <= most) & (part(a, wider) == part(b, wider)), wider).otherwise(found)

    sizes = F.array(*[F.lit(1 << i) for i in range(bits - 1, -1, -1)])
    return F.when((most < 1) | (part(a, one) != part(b, one)), F.lit(0)).otherwise(F.aggregate(sizes, F.lit(0), step))


def trim(pos, ref, alt) -> Column:
    """Struct (pos, ref, alt) without common bases at the right end and then at the left one."""
    kept = lambda t: F.least(F.length(t["ref"]), F.length(t["alt"])) - 1

    def right(t: Column) -> Column:
        cut = lambda n: F.struct(t["pos"].alias("pos"), *[F.left(t[c], F.length(t[c]) - n).alias(c) for c in ("ref", "alt")])
        return _let(_alike(t["ref"], t["alt"], kept(t), True), cut)

    def left(t: Column) -> Column:
        cut = lambda n: F.struct((t["pos"] + n).alias("pos"), *[F.substring(t[c], n + 1, F.length(t[c])).alias(c) for c in ("ref", "alt")])
        return _let(_alike(t["ref"], t["alt"], kept(t), False), cut)

    start = F.struct(_col(pos).cast("long").alias("pos"), _col(ref).alias("ref"), _col(alt).alias("alt"))
    # One base on a side: nothing can go.
    short = F.least(F.length(_col(ref)), F.length(_col(alt))) <= 1
    return F.when(short, start).otherwise(_let(start, lambda t: _let(right(t), left)))


def _shiftable(pos: Column, ref: Column, alt: Column) -> Column:
    return (F.least(F.length(ref), F.length(alt)) == 1) & (F.right(ref, F.lit(1)) == F.right(alt, F.lit(1))) & (pos > 1)


def normalize(rows: DataFrame, reference: DataFrame, contig: str = "contig", pos: str = "pos", ref: str = "ref", alt: str = "alt", strict: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with norm_pos, norm_ref, norm_alt, was_modified and norm_error.

    ``reference`` is a chunk table. Symbolic, missing and empty alleles stay as they are. A variant that
    needs reference bases which are not there keeps its trimmed form and says in norm_error which: its contig is not in the reference, its position
    lies outside the contig, or bases before it are missing; with ``strict`` the query fails.
    """
    up = lambda c: F.upper(F.col(c))
    base = rows.select("*", once(skipped(ref, alt).alias("_skip"), trim(F.col(pos).cast("long"), up(ref), up(alt)).alias("_t")))
    whole = lambda c, plain: F.when(F.col("_skip"), plain).otherwise(F.col(f"_t.{c}"))
    base = base.withColumns({"_p": F.coalesce(whole("pos", F.col(pos).cast("long")), F.col(pos).cast("long")), "_r": F.coalesce(whole("ref", F.col(ref)), F.col(ref)), "_a": F.coalesce(whole("alt", F.col(alt)), F.col(alt))}).drop("_t")
    r, a, p = F.col("_r"), F.col("_a"), F.col("_p")
    base = base.withColumn("_go", F.coalesce(~F.col("_skip") & _shiftable(p, r, a), F.lit(False))).withColumn("_s", F.when(F.length(r) >= F.length(a), r).otherwise(a)).withColumn("_d", (F.length("_s") - 1).cast("long"))

    # Equal alleles match everywhere and end at the contig's first base.
    same = r == a
    go = F.col("_go")
    first = F.when(go, F.when(same, F.lit(1).cast("long")).otherwise(F.greatest(p - WINDOW, F.lit(1).cast("long"))))
    last = F.when(go, F.when(same, F.lit(1).cast("long")).otherwise(p - 1))
    # Rows that ask for nothing are spread: their names are no contig's.
    asked = base.withColumn("_where", F.when(go, F.col(contig)).otherwise(F.concat(F.lit("\u0000"), F.pmod(p, F.lit(1021)).cast("string"))))
    seen = with_bases(asked, reference, "_where", first, last, "_u", chunk)
    u, n = F.col("_u"), F.length("_u")
    # Base k of U from its end is base k of V, what lies m - 1 further on in U + S.
    v = F.substring(F.concat(u, F.col("_s")), F.col("_d").cast("int") + 1, n)
    found = _let(F.struct(u.alias("u"), v.alias("v")), lambda t: _alike(t["u"], t["v"], F.length(t["u"]), True, WINDOW.bit_length()))
    seen = seen.select("*", once(F.when(go & ~same & u.isNotNull(), found).alias("_n")))
    k = F.when(same, p - 1).when(F.col("_n") < n, F.col("_n") + 1).when(p - n <= 1, p - 1).cast("long")
    # Worked out in one place, so that both parts of the rows below stand on one shuffle.
    seen = seen.select("*", once(F.when(go & u.isNotNull(), k).alias("_k"), (go & (u.isNull() | k.isNull())).alias("_open")))
    near = F.when(same, u).otherwise(F.substring(F.concat(u, F.col("_s")), (n - F.col("_k") + 1).cast("int"), F.length("_s")))
    closed = seen.where(~F.col("_open")).withColumns({"_m": near, "norm_error": F.lit(None).cast("string")})
    opened = _with_errors(_long_shifts(seen.where("_open"), reference, chunk), reference, contig, strict)
    every = closed.unionByName(opened.select(*closed.columns)).drop("_n", "_open", "_u", "_where")

    m, one = F.col("_m"), F.substring("_m", 1, 1)
    ok, by_ref = m.isNotNull(), F.length(r) >= F.length(a)
    new = every.withColumns(
        {
            "norm_pos": F.when(ok, p - F.col("_k")).otherwise(p),
            "norm_ref": F.when(ok & by_ref, m).when(ok, one).otherwise(r),
            "norm_alt": F.when(ok & (F.length(r) > F.length(a)), one).when(ok, m).otherwise(a),
        }
    )
    changed = ~F.col("_skip") & ((F.col("norm_pos") != F.col(pos)) | (F.col("norm_ref") != up(ref)) | (F.col("norm_alt") != up(alt)))
    new = new.withColumn("was_modified", F.coalesce(changed, F.lit(False)))
    return new.select(*rows.columns, "norm_pos", "norm_ref", "norm_alt", "was_modified", "norm_error")


def _with_errors(rows: DataFrame, reference: DataFrame, contig: str, strict: bool) -> DataFrame:
    """``rows`` with norm_error: why a row without _m has no bases."""
    p = F.col("_p")
    lengths = reference.groupBy(F.col("contig").alias("_known")).agg(F.max(F.col("start") + F.length("seq") - 1).alias("_length"))
    error = F.when(F.col("_length").isNull(), F.lit(NO_CONTIG)).when(p > F.col("_length") + 1, F.lit(OUT_OF_BOUNDS)).otherwise(F.lit(NO_BASES))
    text = F.when(F.col("_m").isNull(), F.concat(error, F.lit(": "), F.coalesce(F.col(contig), F.lit("null")), F.lit(":"), p.cast("string")))
    if strict:
        text = F.when(text.isNotNull(), F.raise_error(text))
    return rows.join(lengths, F.col(contig) == F.col("_known"), "left").withColumn("norm_error", text).drop("_known", "_length")


def _sides(rows: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (contig ``_where``, chunk ``_chunk``, period ``_d``) with _own, the chunk's bases, and _other, those ``_d`` before each of them; before a contig's first base lie dots."""

    def text(place: str, into: str) -> DataFrame:
        # As the chunks are joined elsewhere, so that they are shuffled once.
        return reference.select(F.col("contig").alias("_where"), F.col("chunk").alias(place), F.col("start").alias(f"{into}_start"), F.col("seq").alias(f"{into}_seq"))

    own = lambda place, into: F.substring(F.col(f"{into}_seq"), (F.col(place) * chunk + 2 - F.col(f"{into}_start")).cast("int"), F.lit(chunk))
    rest = F.pmod(F.col("_d"), F.lit(chunk)).cast("int")
    both = rows.withColumn("_near", F.col("_chunk") - F.floor(F.col("_d") / chunk)).withColumn("_far", F.col("_near") - 1)
    both = both.join(text("_chunk", "_a"), ["_where", "_chunk"], "left").join(text("_near", "_b"), ["_where", "_near"], "left").join(text("_far", "_c"), ["_where", "_far"], "left")
    dots = F.repeat(F.lit("."), F.lit(chunk))
    before = F.when(rest > 0, F.right(F.coalesce(own("_far", "_c"), dots), rest)).otherwise(F.lit(""))
    both = both.withColumn("_own", own("_chunk", "_a")).withColumn("_other", F.concat(before, F.coalesce(own("_near", "_b"), dots)))
    return both.withColumn("_other", F.left("_other", F.length("_own"))).drop("_near", "_far", *[f"{x}_{y}" for x in ("_a", "_b", "_c") for y in ("start", "seq")])


def _last_difference(own: Column, other: Column, start: Column) -> Column:
    """(position, base of ``other``) of the last base of ``own``, which begins at ``start``, that differs from the one in ``other``; null if none does."""

    def found(t: Column) -> Column:
        n = F.length(t["x"])
        return _let(_alike(t["x"], t["y"], n, True), lambda c: F.when(c < n, F.struct((t["at"] + n - 1 - c).alias("pos"), F.substring(t["y"], n - c, F.lit(1)).alias("base"))))

    return _let(F.struct(own.alias("x"), other.alias("y"), start.alias("at")), found)


def _long_shifts(rows: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """``rows`` whose shifts use up the window, or that have none (_u is null), with the shift _k and the allele there _m; nulls where bases are missing.

    A run's end is looked for in all chunks before the variant, once for each contig and period: a row for each such chunk, whatever the number
    of variants. Runs are those of the reference; whether the allele's own bases go with them is seen from the bases before it.
    """
    p, d, s, known = F.col("_p"), F.col("_d"), F.col("_s"), F.col("_u").isNotNull()
    start = F.col("_chunk") * chunk + 1
    spot = F.floor((p - 2) / chunk).cast("long")
    chains = rows.where(known).select("_where", "_d", spot.alias("_chunk")).groupBy("_where", "_d").agg(F.max("_chunk").alias("_last"))
    chains = chains.select("_where", "_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_chunk"))
    marks = _sides(chains, reference, chunk).select("_where", "_d", "_chunk", _last_difference(F.col("_own"), F.col("_other"), start).alias("_mark"))
    before = Window.partitionBy("_where", "_d").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = marks.select("_where", "_d", "_chunk", F.max("_mark").over(before).alias("_earlier"))

    # The allele against as many bases before it: those in the window are alike.
    reach = F.least(d, p - 1)
    far = known & (d > WINDOW)
    wide = with_long_bases(rows, reference, "_where", F.when(far, p - reach), F.when(far, p - 1), "_v", chunk)
    v, n = F.col("_v"), F.length("_v")
    against = F.substring(s, (d - n + 1).cast("int"), n)
    inside = _let(F.struct(v.alias("v"), against.alias("s")), lambda t: _alike(t["v"], t["s"], F.length(t["v"]), True))
    wide = wide.select("*", once(F.when(v.isNotNull(), inside).alias("_i"))).drop("_k")
    wide = wide.withColumn("_short", F.when(F.col("_i") < n, F.col("_i") + 1).when(v.isNotNull() & (p - n <= 1), p - 1).cast("long")).withColumn("_chunk", spot)

    # The reference against itself, in the variant's chunk and then in those before.
    size = (p - start).cast("int")
    here = _last_difference(F.left("_own", size), F.left("_other", size), start)
    ends = _sides(wide, reference, chunk).join(earlier, ["_where", "_d", "_chunk"], "left").select(*wide.columns, once(F.coalesce(here, F.col("_earlier")).alias("_end")))
    # Before the contig's first base all differs.
    run = p - F.col("_end.pos") + d
    ends = ends.withColumn("_k", F.when(known, F.coalesce("_short", F.least(run, p - 1))))
    # The bases along a run are the allele's first ones, turned; only the one at its end is another.
    first = F.left(s, d.cast("int"))
    turn = F.pmod(1 - F.col("_k"), d).cast("int")
    turned = F.concat(F.substring(first, turn + 1, d.cast("int")), F.left(first, turn))
    anchor = F.when(run <= p - 1, F.col("_end.base")).otherwise(F.right(turned, F.lit(1)))
    text = F.when(F.col("_short").isNotNull(), F.substring(F.concat(v, s), (n - F.col("_k") + 1).cast("int"), F.length(s))).otherwise(F.concat(anchor, turned))
    return ends.withColumn("_m", F.when(F.col("_k").isNotNull(), text))

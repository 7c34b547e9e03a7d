"""Features of structures and error matrices, on long tables of atoms (key, chain, resseq, ...) and cells (key, i, j, v).

Indices and places count from 1; a place below 0 counts from the end of the peptide (-1 is the last). Where a peptide's
first index and length are asked for, a number serves all keys and the name of a column of ``cells`` gives each its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _of(x: int | str) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _at(place: Column, first: Column, length: Column) -> Column:
    """Index of a place of the peptide; null where the peptide has no such place."""
    index = F.when(place < 0, first + length + place).otherwise(first + place - 1)
    return F.when((place != 0) & (F.abs(place) <= length), index)


def block_means(cells: DataFrame, key: list[str], is_a: Column, is_b: Column, name: str = "mean") -> DataFrame:
    """Mean over both directed blocks between two sets of indices; ``is_a`` and ``is_b`` are functions of the index Column."""
    a_to_b = is_a(F.col("i")) & is_b(F.col("j"))
    b_to_a = is_b(F.col("i")) & is_a(F.col("j"))
    return cells.groupBy(*key).agg(F.avg(F.when(a_to_b | b_to_a, F.col("v"))).alias(name))


def at_the_end(cells: DataFrame, key: list[str], length: str, first: str = "first") -> DataFrame:
    """Add ``first``, the index where a peptide of ``length`` (a column) begins if it stands last in the matrix.

    Keys whose matrix is no longer than the peptide, or whose length is null or not positive, are left out.
    """
    size = cells.groupBy(*key).agg(F.max("i").alias("_n"))
    out = cells.join(size, key).filter((F.col(length) > 0) & (F.col(length) < F.col("_n")))
    return out.withColumn(first, F.col("_n") - F.col(length) + 1).drop("_n")


def _cross(first: Column, length: Column) -> tuple[Column, Column, Column]:
    inside = lambda x: (F.col(x) >= first) & (F.col(x) < first + length)
    return inside("i"), inside("j"), inside("i") != inside("j")


def interface_pae(cells: DataFrame, key: list[str], first: int | str, length: int | str) -> DataFrame:
    """Mean error over both directed blocks between peptide and rest: of the whole peptide, its second place (of a single
    letter: the first) and its last, the mean of these two; and inside the peptide, and over the whole matrix."""
    a, n = _of(first), _of(length)
    i_in, j_in, cross = _cross(a, n)

    def place(p: Column) -> Column:
        return F.avg(F.when(cross & ((F.col("i") == p) | (F.col("j") == p)), F.col("v")))

    second, end = place(a + F.least(F.lit(1), n - 1)), place(a + n - 1)
    return cells.groupBy(*key).agg(
        F.avg(F.when(cross, F.col("v"))).alias("pae_pep_mhc"),
        second.alias("pae_anchor2"),
        end.alias("pae_anchor_last"),
        ((second + end) / 2).alias("pae_anchors"),
        F.avg(F.when(i_in & j_in, F.col("v"))).alias("pae_pep"),
        F.avg("v").alias("pae_all"),
    )


def anchor_pae(cells: DataFrame, anchors: DataFrame, key: list[str], first: int | str, length: int | str) -> DataFrame:
    """Mean over each key's own anchor places (``anchors``: array) of their mean error against the rest: ``pae_anchors_ic``.

    Places that the peptide doesn't have are passed over; keys without any have no row.
    """
    _, _, cross = _cross(_of(first), _of(length))
    wanted = anchors.select(*key, F.posexplode("anchors").alias("_k", "_a"))
    own = cells.filter(cross).join(wanted, key).withColumn("_p", _at(F.col("_a"), _of(first), _of(length)))
    per = own.filter((F.col("i") == F.col("_p")) | (F.col("j") == F.col("_p"))).groupBy(*key, "_k").agg(F.avg("v").alias("_v"))
    return per.groupBy(*key).agg(F.avg("_v").alias("pae_anchors_ic"))


def consistency(cells: DataFrame, key: list[str], first: int | str, length: int | str) -> DataFrame:
    """Spread (population) of the peptide places' mean errors in their own rows, and how far the two directions differ."""
    i_in, j_in, _ = _cross(_of(first), _of(length))
    marked = cells.withColumns({"_fwd": i_in & ~j_in, "_rev": j_in & ~i_in}).filter("_fwd OR _rev")
    rows = marked.groupBy(*key, F.when(F.col("_fwd"), F.col("i")).alias("_p")).agg(F.avg("v").alias("_m"), F.sum("v").alias("_s"), F.count("v").alias("_c"))
    forward = F.col("_p").isNotNull()
    mean = lambda c: F.sum(F.when(c, F.col("_s"))) / F.sum(F.when(c, F.col("_c")))
    return rows.groupBy(*key).agg(F.stddev_pop(F.when(forward, F.col("_m"))).alias("pae_spread"), F.abs(mean(forward) - mean(~forward)).alias("asymmetry"))


def residues(atoms: DataFrame, key: list[str], chain: str) -> DataFrame:
    """``key``, ``resseq``, ``place`` (from 1, in order of ``resseq``), ``length`` and ``b``, the mean B factor, of a chain."""
    res = atoms.filter(F.col("chain") == chain).groupBy(*key, "resseq").agg(F.avg("b").alias("b"))
    w = Window.partitionBy(*key)  # the residues of one chain
    return res.withColumns({"place": F.row_number().over(w.orderBy("resseq")), "length": F.count(F.lit(1)).over(w)})


def _is_anchor(places: Column, place: Column, length: Column) -> Column:
    return F.exists(places, lambda a: F.coalesce(_at(a, F.lit(1), length) == place, F.lit(False)))


def confidence_consistency(atoms: DataFrame, anchors: DataFrame, key: list[str], peptide_chain: str) -> DataFrame:
    """``plddt_spread`` (population) of the peptide's residues and ``anchor_gap``, the mean at the anchors less that elsewhere.

    ``anchors``: key and array of places; the gap is null where a key has no anchors or nothing else.
    """
    res = residues(atoms, key, peptide_chain).join(anchors.select(*key, "anchors"), key, "left")
    is_anchor = F.coalesce(_is_anchor(F.col("anchors"), F.col("place"), F.col("length")), F.lit(False))
    mean = lambda c: F.avg(F.when(c, F.col("b")))
    return res.withColumn("_a", is_anchor).groupBy(*key).agg(F.stddev_pop("b").alias("plddt_spread"), (mean(F.col("_a")) - mean(~F.col("_a"))).alias("anchor_gap"))


def heavy(atoms: DataFrame) -> DataFrame:
    return atoms.filter("element <> 'H'")


def atom_pairs(atoms: DataFrame, key: list[str], peptide_chain: str, other_chain: str, within: float | None = None) -> DataFrame:
    """Distances of peptide atoms to the other chain's atoms of the same structure: ``pep_res``, ``mhc_res``, ``d``.

    With ``within``, space is cut into cubes of that edge and an atom looks only into its own and the 26 around it.
    """
    p = atoms.filter(F.col("chain") == peptide_chain).select(*key, F.col("resseq").alias("pep_res"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    m = atoms.filter(F.col("chain") == other_chain).select(*key, F.col("resseq").alias("mhc_res"), *[F.col(c).alias(f"m{c}") for c in "xyz"])
    on = list(key)
    if within is not None:
        cell = lambda c: F.floor(F.col(c) / F.lit(within))
        around = lambda c: F.explode(F.array(*[cell(c) + o for o in (-1, 0, 1)]))
        for c in "xyz":
            p = p.withColumn(f"_c{c}", around(f"p{c}"))
            m = m.withColumn(f"_c{c}", cell(f"m{c}"))
        on += ["_cx", "_cy", "_cz"]
    sq = sum(((F.col(f"p{c}") - F.col(f"m{c}")) * (F.col(f"p{c}") - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0))
    out = p.join(m, on).withColumn("d", F.sqrt(sq)).select(*key, "pep_res", "mhc_res", "d")
    return out if within is None else out.filter(F.col("d") <= within)


def contact_features(atoms: DataFrame, key: list[str], peptide_chain: str, other_chain: str, cutoff: float = 4.0) -> DataFrame:
    """Residue contacts (least atom distance up to ``cutoff``): their number, residues touching on each side, contacts per
    peptide residue (those without any included), and the least distance of all. Structures without both chains have no
    row."""
    res = atom_pairs(atoms, key, peptide_chain, other_chain).groupBy(*key, "pep_res", "mhc_res").agg(F.min("d").alias("d"))
    near = F.col("d") <= cutoff
    pep, mhc = F.count_distinct(F.when(near, F.col("pep_res"))), F.count_distinct(F.when(near, F.col("mhc_res")))
    n = F.sum(near.cast("bigint"))
    return res.groupBy(*key).agg(n.alias("n_contacts"), pep.alias("n_pep_residues"), mhc.alias("n_mhc_residues"), (n / F.count_distinct("pep_res")).alias("mean_degree"), F.min("d").alias("min_distance"))


def interface_geometry(atoms: DataFrame, key: list[str], peptide_chain: str, other_chain: str, anchors: DataFrame | None = None, contact: float = 4.5, close: float = 3.5) -> DataFrame:
    """Pairs of heavy atoms nearer than ``contact`` and ``close``; the former per residue, at the second and the last residue
    of each peptide; these two's least distances, the mean least distance per residue, and the share of the peptide's atoms
    that touch. With ``anchors`` (key, array of places) also the contacts at these, null where the peptide has none.

    Peptides with fewer than two residues have no row.
    """
    hv = heavy(atoms).withColumn("_atom", F.monotonically_increasing_id()).select("*", F.struct("resseq", "_atom").alias("_r")).drop("resseq").withColumnRenamed("_r", "resseq")
    d = atom_pairs(hv, key, peptide_chain, other_chain)
    per_atom = d.groupBy(*key, F.col("pep_res.resseq").alias("res"), F.col("pep_res._atom").alias("atom")).agg(F.sum((F.col("d") < contact).cast("bigint")).alias("c"), F.sum((F.col("d") < close).cast("bigint")).alias("h"), F.min("d").alias("m"))
    res = per_atom.groupBy(*key, "res").agg(F.sum("c").alias("c"), F.sum("h").alias("h"), F.min("m").alias("m"), F.sum((F.col("c") > 0).cast("bigint")).alias("t"), F.count(F.lit(1)).alias("a"))
    w = Window.partitionBy(*key)  # the residues of one peptide
    res = res.withColumns({"place": F.row_number().over(w.orderBy("res")), "length": F.count(F.lit(1)).over(w)}).filter("length >= 2")
    second, last = F.col("place") == 2, F.col("place") == F.col("length")
    at = lambda where, c: F.max(F.when(where, F.col(c)))
    more = []
    if anchors is not None:
        res = res.join(anchors.select(*key, "anchors"), key, "left")
        times = F.size(F.filter("anchors", lambda a: _at(a, F.lit(1), F.col("length")) == F.col("place")))
        more = [F.sum(F.when(times > 0, F.col("c") * times)).alias("anchor_ic_contacts")]
    return res.groupBy(*key).agg(
        F.sum("c").alias("n_contacts"),
        F.sum("h").alias("n_close"),
        F.avg("c").alias("contacts_per_residue"),
        at(second, "c").alias("anchor2_contacts"),
        at(last, "c").alias("anchor_last_contacts"),
        at(second, "m").alias("anchor2_min"),
        at(last, "m").alias("anchor_last_min"),
        F.avg("m").alias("mean_min_dist"),
        (F.sum("t") / F.sum("a")).alias("buried_frac"),
        *more,
    )


def interface_plddt(atoms: DataFrame, key: list[str], peptide_chain: str, other_chain: str, cutoff: float = 5.0) -> DataFrame:
    """Mean B factor (confidence) of the peptide residues with an atom within ``cutoff`` of the other chain (null: none), of
    all peptide residues, and the numbers of both."""
    near = atom_pairs(atoms, key, peptide_chain, other_chain, cutoff).select(*key, F.col("pep_res").alias("resseq")).distinct()
    marked = residues(atoms, key, peptide_chain).join(near.withColumn("_t", F.lit(True)), [*key, "resseq"], "left")
    return marked.groupBy(*key).agg(F.avg(F.when(F.col("_t"), F.col("b"))).alias("interface_plddt"), F.avg("b").alias("peptide_plddt"), F.count("_t").alias("n_interface"), F.count(F.lit(1)).alias("n_peptide"))


#: Features that a changed sequence needs a new fold for; the others can be had on the backbone of the wild type.
NEEDS_FOLD = {"interface_plddt": True, "peptide_plddt": True, "ipsae": True, "n_contacts": False, "mean_degree": False, "min_distance": False, "shape_complementarity": False}


def structure_features(atoms: DataFrame, key: list[str], peptide_chain: str, other_chain: str, more: DataFrame | None = None) -> DataFrame:
    """Contacts and confidences side by side, with the columns of ``more`` (such as an external score per key) beside them;
    shape complementarity isn't reckoned and is null."""
    a, b = contact_features(atoms, key, peptide_chain, other_chain), interface_plddt(atoms, key, peptide_chain, other_chain)
    out = a.join(b, key, "full").withColumn("shape_complementarity", F.lit(None).cast("double"))
    return out if more is None else out.join(more, key, "left")


def feature_subset(df: DataFrame, key: list[str], needs_fold: bool, tags: dict[str, bool] | None = None) -> DataFrame:
    """The features whose tag says that they need (or don't need) a new fold; untagged ones are in neither subset."""
    tags = NEEDS_FOLD if tags is None else tags
    return df.select(*key, *[c for c in df.columns if tags.get(c) is needs_fold])

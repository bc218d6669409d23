"""What is packed into names: frames, domain families, clades, windows, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUFFIX = r"^([\s\S]*)\|(fwd|rev)([\s\S]*)$"


def frame_suffix(target: Column) -> dict[str, Column]:
    """``base``, ``strand``, ``frame`` of a name that ends in a bar, fwd or rev and a frame from 1; ``.`` where it does not."""
    way, last = F.regexp_extract(target, _SUFFIX, 2), F.right(target, F.lit(1)).try_cast("int")
    found = (way != "") & last.isNotNull() & ~F.regexp_extract(target, _SUFFIX, 3).contains("|")
    return {
        "base": F.when(found, F.regexp_extract(target, _SUFFIX, 1)).otherwise(target),
        "strand": F.when(found & (way == "fwd"), "+").when(found, "-").otherwise("."),
        "frame": F.when(found, (last - 1).cast("string")).otherwise("."),
    }


def frame_number(target: Column) -> dict[str, Column]:
    """As ``frame_suffix``, with numbers: a name without a frame has frame 0; ``direction`` is 1, -1 or 0."""
    parts = frame_suffix(target)
    direction = F.when(parts["strand"] == "+", 1).when(parts["strand"] == "-", -1).otherwise(0)
    return {"base": parts["base"], "strand": parts["strand"], "direction": direction, "frame": F.coalesce(parts["frame"].try_cast("int"), F.lit(0))}


def base_name(target: Column) -> Column:
    """The name before its last bar, whatever follows."""
    return F.when(F.instr(target, "|") > 0, F.regexp_extract(target, r"^([\s\S]*)\|", 1)).otherwise(target)


def domain_family(model: Column) -> Column:
    """After the colon the part behind the last hyphen; without a colon the part before the first underscore."""
    after = F.substring_index(F.element_at(F.split(model, ":", 3), 2), "-", -1)
    return F.when(F.instr(model, ":") > 0, after).otherwise(F.substring_index(model, "_", 1))


def path_labels(model: Column) -> dict[str, Column]:
    """``order``, ``superfamily``, ``clade``, ``gene`` of names such as ``Class_I/LTR/Ty1_copia/x:Ty1-RT``."""
    path, has = F.substring_index(model, ":", 1), F.instr(model, ":") > 0
    parts = F.split(path, "/")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("unknown"))
    starts = lambda p: has & path.startswith(p)
    known = [("Class_I/LTR/Ty1_copia", F.lit("LTR"), F.lit("Copia")), ("Class_I/LTR/Ty3_gypsy", F.lit("LTR"), F.lit("Gypsy")), ("Class_I/", part(1), part(2)), ("Class_II/", part(2), part(3)), ("NA", F.lit("LTR"), F.lit("Retrovirus"))]
    order, superfamily = F.lit("Unknown"), F.lit("unknown")
    for prefix, o, s in reversed(known):
        order, superfamily = F.when(starts(prefix), o).otherwise(order), F.when(starts(prefix), s).otherwise(superfamily)
    gene = F.substring_index(F.substring(model, F.instr(model, ":") + 1, F.length(model)), "-", -1)
    return {"order": order, "superfamily": superfamily, "clade": F.when(has, F.substring_index(path, "/", -1)).otherwise(model), "gene": F.when(has, gene).otherwise(model)}


def prefix_labels(model: Column) -> dict[str, Column]:
    """``gene`` and ``clade`` of names such as ``RT_copia``; without an underscore the clade is the whole name."""
    at = F.instr(model, "_")
    return {"gene": F.substring_index(model, "_", 1), "clade": F.when(at > 0, F.substring(model, at + 1, F.length(model))).otherwise(model)}


def tidy_label(*levels: Column) -> Column:
    """Levels joined by slashes, without ``unknown`` and repeats."""
    return F.array_join(F.array_distinct(F.filter(F.array(*levels), lambda x: x != "unknown")), "/")


def gff_safe(name: Column) -> Column:
    return F.regexp_replace(name, "[;=|]", "_")


def file_safe(model: Column) -> Column:
    return F.translate(model, "/: ", "___")


def window_parts(window: Column) -> dict[str, Column]:
    """``chrom`` and the offsets of ``chrom:from-to``; the name itself and nulls where it is no window."""
    rx = r"^([\s\S]+):(\d+)-(\d+)$"
    found = window.rlike(rx)
    return {"chrom": F.when(found, F.regexp_extract(window, rx, 1)).otherwise(window), "w_start": F.when(found, F.regexp_extract(window, rx, 2).cast("bigint")), "w_end": F.when(found, F.regexp_extract(window, rx, 3).cast("bigint"))}


def stable_id(name: Column) -> Column:
    """63 bits of the name's SHA-256: its first eight bytes, least significant first, without the sign."""
    digest = F.sha2(name, 256)
    little = F.concat(*(F.substring(digest, 15 - 2 * i, 2) for i in range(8)))
    # The top hex digit loses its sign bit before the number is read, so it fits a bigint.
    top = F.conv(F.conv(F.substring(little, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7)).cast("string"), 10, 16)
    return F.conv(F.concat(top, F.substring(little, 2, 15)), 16, 10).cast("bigint")

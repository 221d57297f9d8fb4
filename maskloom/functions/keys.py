"""Column functions on paths, names and ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind.
COMPOUND = (".nii.gz", ".ppm.gz")
VOLUMES = (".nii", ".nii.gz", ".mha", ".mhd", ".nrrd", ".dcm", ".mat", ".h5")
VIDEOS = (".mp4", ".avi", ".mov", ".mkv")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".gif", ".ppm", ".ppm.gz")


def base_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ext_of(path: Column) -> Column:
    """Extension in lower case with its point; `.nii.gz` and `.ppm.gz` count as one; none is ''."""
    return F.lower(F.regexp_extract(base_of(path), r"(?i)(\.nii\.gz|\.ppm\.gz|\.[^.]+)$", 1))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(base_of(path), r"(?i)(\.nii\.gz|\.ppm\.gz|\.[^.]+)$", "")


def has_mask_key(path: Column, key: str) -> Column:
    return F.contains(F.lower(stem_of(path)), F.lit(key.lower()))


def in_folders(path: Column, names: list[str]) -> Column:
    """Whether a folder of the path has one of the names, in any case."""
    return F.arrays_overlap(F.split(F.lower(dir_of(path)), "/"), F.array(*[F.lit(n.lower()) for n in names]))


def pipeline_of(path: Column) -> Column:
    e = ext_of(path)
    return F.when(e.isin(*VIDEOS), "Video").when(e.isin(*VOLUMES), "3D").otherwise("2D")


def dim_of(path: Column) -> Column:
    return F.when(ext_of(path).isin(*VOLUMES), 3).otherwise(2)


def modality_list(x: Column) -> Column:
    """Lower-cased, trimmed entries of a comma list, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda m: F.lower(F.trim(m))), lambda m: m != "")


def modality_wanted(x: Column, wanted: list[str]) -> Column:
    """Whether an entry is wanted; no list, `all` or `*` wants everything."""
    names = [w.strip().lower() for w in wanted if w.strip()]
    if not names or {"all", "*"} & set(names):
        return F.lit(True)
    return F.arrays_overlap(modality_list(x), F.array(*map(F.lit, names)))


def class_from_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(base_of(path), "%([^%]+)%", 1), F.lit(""))


def number_after(path: Column, words: str) -> Column:
    """The number after `_word` in the name, for one of the alternatives in `words`; null if none."""
    return F.nullif(F.regexp_extract(base_of(path), rf"_(?:{words})(\d+)", 1), F.lit("")).cast("int")


def idx_from_name(path: Column) -> Column:
    return number_after(path, "img|frame|slice")


def mask_idx_from_name(path: Column) -> Column:
    return number_after(path, "mask")


def stem_key(path: Column) -> Column:
    """Stem in lower case without mask and label words, other characters as single underscores."""
    bare = F.regexp_replace(F.lower(stem_of(path)), "mask|label|segmentation|seg", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_path(x: Column) -> Column:
    """Forward slashes, no `file:` head, no repeated slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), r"\\", "/"), "^file:", ""), "/+", "/")


def safe_name(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "[^A-Za-z0-9._-]+", "_")


def short_id(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, 8)


def pad_id(x: Column, prefix: str, width: int) -> Column:
    """Zero-pad the number that ends an id with the prefix; others stay."""
    n = F.regexp_extract(x, rf"^{prefix}(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit(prefix), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n))).otherwise(x)


def file_type_category(exts: Column) -> Column:
    """image, volume, video, mixed or unknown for an array of extensions."""
    kind = lambda e: F.when(e.isin(*VIDEOS), "video").when(e.isin(*VOLUMES), "volume").when(e.isin(*IMAGES), "image").otherwise("unknown")
    kinds = F.array_distinct(F.transform(exts, kind))
    return F.when(F.size(kinds) == 1, kinds[0]).when(F.size(kinds) == 0, "unknown").otherwise("mixed")


class Pattern:
    """A Python pattern with named groups as one that Java takes: plain groups, their names kept aside, the whole value matched.

    A group that takes no part in a match gives the empty text, which the callers drop."""

    def __init__(self, pattern: str):
        self.names = dict(sorted(re.compile(pattern).groupindex.items(), key=lambda x: x[1]))
        numbers = dict(self.names)
        text = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{numbers[m[1]]}", pattern)
        self.java = r"\A(?:" + re.sub(r"\(\?P<\w+>", "(", text) + r")\z"

    def matches(self, x: Column) -> Column:
        return x.rlike(self.java)

    def group(self, x: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(x, self.java, self.names[name]), F.lit("")) if name in self.names else F.lit(None).cast("string")

    def extras(self, x: Column) -> Column:
        """Map of the other groups that took part, by name."""
        pairs = [F.struct(F.lit(n).alias("key"), self.group(x, n).alias("value")) for n in sorted(self.names) if n != "id"]
        if not pairs:
            return F.create_map().cast("map<string,string>")
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def extract_id(path: Column, strategy: str, pattern: str | None = None) -> Column:
    """The id of a path: `regex-file` by name, `regex` by path, `regex-folder` by name or else the parent folder, `filename` the stem."""
    if strategy == "filename":
        return stem_of(path)
    p = Pattern(pattern)
    if strategy == "regex":
        return p.group(path, "id")
    found = p.group(base_of(path), "id")
    return F.coalesce(found, F.nullif(base_of(dir_of(path)), F.lit(""))) if strategy == "regex-folder" else found


def composite_id(split: Column, ident: Column, extras: Column) -> Column:
    """split, id, `__ID2__x__` and the other captures by name, joined by underscores."""
    rest = F.transform(F.array_sort(F.filter(F.map_entries(extras), lambda e: e["key"] != "id2")), lambda e: e["value"])
    id2 = F.try_element_at(extras, F.lit("id2"))
    return F.concat_ws("_", split, ident, F.when(id2.isNotNull(), F.concat(F.lit("__ID2__"), id2, F.lit("__"))), F.array_join(F.nullif(rest, F.array().cast("array<string>")), "_"))


def unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from an md5 of seed and key: the same on every engine."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def parse_pairs(x: Column, outer: str, inner: str) -> Column:
    """`a=1|b=2` as an array of (key, value) texts, trimmed; entries without the inner mark are left out."""
    parts = F.filter(F.split(F.coalesce(x, F.lit("")), re.escape(outer)), lambda p: F.contains(p, F.lit(inner)))
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, inner, 1)).alias("key"), F.trim(F.substring(p, F.instr(p, inner) + 1, F.length(p))).alias("value")))


def meta_value(*values: Column, default: str = "unknown") -> Column:
    """The first value that says something: not null, blank or `none`; trimmed."""
    said = lambda v: F.when(F.lower(F.trim(v.cast("string"))).isin("", "none"), None).otherwise(F.trim(v.cast("string")))
    return F.coalesce(*map(said, values), F.lit(default))


def split_of_path(path: Column, test: tuple[str, ...] = ("valid", "test"), segment: int = 0, default: str = "train") -> Column:
    """`test` where a segment of the path (from 0) is one of the test folders in any case; else the default."""
    return F.when(F.coalesce(F.lower(F.get(F.split(path, "/"), F.lit(segment))).isin(*test), F.lit(False)), "test").otherwise(default)

"""Columns of image metadata (map<string, string>), file names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenequery.functions.camera import geodetic_to_ecef

#: Names of the entries that hold a value, in the order that they are tried.
TAKEN = ["Exif:DateTimeOriginal", "DateTimeOriginal", "DateTime", "Date Time", "Create Date", "ctime"]
FOCAL, FOCAL35 = ["Exif:FocalLength", "FocalLength", "focalLength", "focal length", "lens_focal_length"], ["Exif:FocalLengthIn35mmFilm", "FocalLengthIn35mmFilm"]
UNIQUE_ID = ["Exif:ImageUniqueID", "ImageUniqueID"]
SERIALS = [["Exif:BodySerialNumber", "Body Serial Number", "BodySerialNumber"], ["Exif:LensSerialNumber", "Lens Serial Number", "LensSerialNumber"]]
WIDTH, HEIGHT = ["Exif:PixelXDimension", "PixelXDimension"], ["Exif:PixelYDimension", "PixelYDimension"]


def find(meta: Column, name: str) -> Column:
    """The value under name; else that of the first key, in order, that equals it in lower case, after its last / or : where the key is longer.  Null if there is none."""
    plain = F.lower(F.lit(name))

    def near(key: Column) -> Column:
        low = F.lower(key)
        return F.when(F.length(key) > len(name), F.regexp_extract(low, "([^/:]*)$", 1)).otherwise(low) == plain

    keys = F.filter(F.array_sort(F.map_keys(meta)), near)
    return F.coalesce(F.try_element_at(meta, F.lit(name)), F.try_element_at(meta, F.get(keys, 0)))


def first(meta: Column, names: list[str]) -> Column:
    return F.coalesce(*[find(meta, n) for n in names])


def has(meta: Column, names: list[str]) -> Column:
    """Whether any of the names is there; its value may be empty."""
    return first(meta, names).isNotNull()


NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def leading_number(text: Column) -> Column:
    """The number that a text begins with, or null."""
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def has_number(meta: Column, names: list[str], positive: bool) -> Column:
    """Whether the first of the names with a leading number has one, and above 0 if that is asked."""
    value = F.coalesce(*[leading_number(find(meta, n)) for n in names])
    return F.coalesce((value > 0) if positive else value.isNotNull(), F.lit(False))


def real_number(text: Column) -> Column:
    """a / b anywhere in a text (0 where b is 0), else its leading number, else -1."""
    a, b = (F.regexp_extract(text, "([0-9]+)/([0-9]+)", k).try_cast("double") for k in (1, 2))
    part = F.when(b == 0, 0.0).otherwise(a / b)
    return F.when(text.rlike("[0-9]+/[0-9]+"), part).otherwise(F.coalesce(leading_number(text), F.lit(-1.0)))


def double_value(meta: Column, names: list[str]) -> Column:
    text = first(meta, names)
    return F.when(F.coalesce(text, F.lit("")) == "", -1.0).otherwise(real_number(text))


def int_value(meta: Column, names: list[str]) -> Column:
    return F.coalesce(F.regexp_extract(first(meta, names), r"^\s*([-+]?[0-9]+)", 1).try_cast("int"), F.lit(-1))


def degrees(text: Column, reference: Column) -> Column:
    """Degrees, minutes, seconds with commas between; negative for S and W; an error for another reference."""
    parts = F.split(text, ",")
    value = F.aggregate(F.transform(parts, lambda p, i: F.trim(p).cast("double") * F.pow(F.lit(60.0), -i)), F.lit(0.0), lambda s, x: s + x)
    bad = F.raise_error(F.concat(F.lit("unexpected reference: "), reference)).cast("double")
    return F.when(reference.isin("S", "W"), -value).when(reference.isin("N", "E"), value).otherwise(bad)


def altitude(text: Column, reference: Column) -> Column:
    """Metres; below the sea for 1; an error for another reference than 0 and 1."""
    bad = F.raise_error(F.concat(F.lit("unexpected reference: "), reference)).cast("double")
    value = text.cast("double")
    return F.when(reference == "1", -value).when(reference == "0", value).otherwise(bad)


def position(meta: Column) -> tuple[Column, Column, Column]:
    """Earth-centred metres from GPS entries; null without them."""
    lat = degrees(first(meta, ["GPS:Latitude"]), first(meta, ["GPS:LatitudeRef"]))
    lon = degrees(first(meta, ["GPS:Longitude"]), first(meta, ["GPS:LongitudeRef"]))
    alt = altitude(first(meta, ["GPS:Altitude"]), first(meta, ["GPS:AltitudeRef"]))
    there = F.lit(True)
    for n in ("Latitude", "LatitudeRef", "Longitude", "LongitudeRef", "Altitude", "AltitudeRef"):
        there = there & has(meta, [f"GPS:{n}"])
    return tuple(F.when(there, x) for x in geodetic_to_ecef(lat, lon, alt))


def focal_length(meta: Column) -> Column:
    """Millimetres; -1 where none is given."""
    return F.when(has_number(meta, FOCAL, True), double_value(meta, FOCAL)).otherwise(-1.0)


def sensor_width(meta: Column, width: Column, height: Column, listed: Column) -> Column:
    """Millimetres along the longer side: given, or from the list of cameras, or from the focal length for 35 mm film; else null."""
    given = double_value(meta, ["SensorWidth"])
    film = double_value(meta, FOCAL35)
    ratio = F.greatest(width, height) / F.least(width, height)
    diagonal = 43.266615305567875 * focal_length(meta) / film
    scaled = diagonal / F.sqrt(1 + 1 / (ratio * ratio))
    return F.coalesce(F.when(given > 0, given), listed, F.when((film > 0) & (focal_length(meta) > 0), scaled))


def stamp(text: Column) -> Column:
    """Seconds on a calendar of 12 months of 31 days, of "Y:M:D h:m:s"; -1 for other texts."""
    parts = [F.regexp_extract(text, r"^(\d+):(\d+):(\d+) (\d+):(\d+):(\d+)$", k).try_cast("long") for k in range(1, 7)]
    out = parts[0]
    for x, n in zip(parts[1:], (12, 31, 24, 60, 60)):
        out = out * n + x
    return F.coalesce(out, F.lit(-1).cast("long"))


def taken(meta: Column) -> Column:
    return stamp(F.coalesce(first(meta, TAKEN), F.lit("")))


STEM = r"^(.*[^0-9])?([0-9]+)([-_.].*[A-Za-z].*)?$"


def stem_number(stem: Column) -> tuple[Column, Column, Column]:
    """Number, what is before it and what is behind it; null, "" and "" without a number."""
    return F.regexp_extract(stem, STEM, 2).try_cast("long"), F.regexp_extract(stem, STEM, 1), F.regexp_extract(stem, STEM, 3)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def extension_of(path: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r".(\.[^.]*)$", 1)


def view_id(path: Column, meta: Column, written: Column) -> Column:
    """A view's number from what identifies its image: extension; unique id or name; serial numbers, or the folder; time and counter, or when the file was written; sizes."""
    unique = first(meta, UNIQUE_ID)
    body, lens = (F.coalesce(first(meta, n), F.lit("")) for n in SERIALS)
    device = F.when((body != "") | (lens != ""), F.concat_ws("\x1f", body, lens)).when(unique.isNull(), folder_of(path))
    when = F.concat_ws("\x1f", first(meta, ["Exif:DateTimeOriginal", "DateTimeOriginal"]), first(meta, ["Exif:SubsecTimeOriginal", "SubsecTimeOriginal"]), first(meta, ["imageCounter"]))
    when = F.when(when != "", when).otherwise(F.coalesce(first(meta, ["DateTime"]), written.cast("string")))
    h = F.xxhash64(F.lower(extension_of(path)), F.coalesce(unique, F.lower(stem_of(path))), device, when, int_value(meta, WIDTH), int_value(meta, HEIGHT))
    return F.pmod(h, F.lit((1 << 31) - 1))


def incomplete_view_id(path: Column, meta: Column, written: Column, given: Column, pattern: str | None = None) -> Column:
    """The given number; else, with a pattern, the one that its first group finds in the path; else `view_id`."""
    found = F.regexp_extract(path, pattern, 1).try_cast("long") if pattern else F.lit(None).cast("long")
    return F.coalesce(given.cast("long"), found, view_id(path, meta, written))


def zero_padded(n: Column, width: int) -> Column:
    """Never shorter than the number itself."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def reduced(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def names(text: Column) -> Column:
    """The names of a list with commas, trimmed, in lower case, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def matrix_text(values: Column) -> Column:
    """A matrix as a list of numbers written as strings, as scene documents hold it."""
    return F.to_json(F.transform(values, lambda x: x.cast("string")))


def matrix_of(text: Column) -> Column:
    return F.transform(F.from_json(text, "array<string>"), lambda x: x.cast("double"))


def loose_glob(glob: str) -> str:
    """A pattern for *, ?, # (a digit) and @ (digits) that leaves all else as a pattern, dots included, and isn't bound to the ends."""
    out = glob
    for mark, part in (("*", ".*"), ("?", "."), ("@", "[0-9]+"), ("#", "[0-9]")):
        out = out.replace(mark, part)
    return out


def has_value(meta: Column, name: str) -> Column:
    """Whether an entry is there under exactly that name and is not empty."""
    return F.coalesce(F.try_element_at(meta, F.lit(name)) != "", F.lit(False))


def hash_of(*columns: Column) -> Column:
    """One number of several values."""
    return F.xxhash64(*columns)

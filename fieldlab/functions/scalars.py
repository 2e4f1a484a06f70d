"""Column expressions over names, paths, texts, score arrays and maps. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
#: Suffixes of audio and image files.
AUDIO_SUFFIXES = (".wav", ".mp3", ".ogg")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".ppm", ".bmp", ".pgm", ".tif", ".tiff", ".webp")
#: Marks that augmentation leaves in a file name, and the kind each stands for.
AUGMENTATION_MARKS = {"_bgd": "add_bg", "-shift": "time_shift", "-volume": "volume", "-noise": "noise", "-fmask": "mask", "-tmask": "mask"}
#: Texts that mean true.
TRUE_TEXTS = ("1", "y", "Y", "yes", "Yes", "True")
#: Keys of run properties in file names, with their types.
RUN_PROPERTIES = {
    "net": "string", "pre": "boolean", "frz": "int", "lr": "double", "opt": "string",
    "bs": "int", "ks": "int", "folds": "int", "gray": "boolean", "classes": "int",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- names and paths --------------------------------------------------------
def natural_key(s: Column | str) -> Column:
    """Text that sorts like s with its digit runs, of any length, read as numbers: Foo3 before Foo30."""
    runs = F.regexp_extract_all(_col(s), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def sized(x: Column) -> Column:
        digits = F.ltrim(x, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(runs, lambda x: F.when(F.rlike(x, F.lit("^[0-9]")), sized(x)).otherwise(x)), "")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_extract(base_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def suffix(path: Column | str) -> Column:
    """Last suffix with its dot, or ''."""
    return F.regexp_extract(base_name(path), r"^.+?(\.[^.]+)$", 1)


def directory(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"/?[^/]*$", "")


def path_elements(path: Column | str) -> Column:
    """struct(root, fname, suffix)."""
    return F.struct(directory(path).alias("root"), stem(path).alias("fname"), suffix(path).alias("suffix"))


def recording_id(path: Column | str) -> Column:
    """AMnn_yyyymmdd_hhmmss in the file's stem, else null."""
    found = F.regexp_extract(stem(path), r"_?(AM[0-9]{2}_[0-9]{8}_[0-9]{6})", 1)
    return F.when(found != "", found)


def original_file_name(path: Column | str) -> Column:
    """The file an augmented one was made from: its stem up to the first '-', suffix and directory kept."""
    p = _col(path)
    root = F.regexp_extract(p, r"^(.*/)?", 0)
    return F.concat(root, F.element_at(F.split(stem(p), "-"), 1), suffix(p))


def augmentation_kind(name: Column | str, otherwise: str | None = None) -> Column:
    """Kind of the first known mark in the name."""
    out = F.lit(otherwise).cast("string")
    for mark, kind in reversed(AUGMENTATION_MARKS.items()):
        out = F.when(F.contains(_col(name), F.lit(mark)), kind).otherwise(out)
    return out


def clean_filename(name: Column | str) -> Column:
    return F.translate(_col(name), "/ ()", "____")


def is_audio_file(path: Column | str) -> Column:
    return suffix(path).isin(*AUDIO_SUFFIXES)


def is_image_file(path: Column | str) -> Column:
    """Suffixes are compared as they are: an upper-case one is none of an image."""
    return suffix(path).isin(*IMAGE_SUFFIXES)


def vocalization_type(kind: Column | str) -> Column:
    """CALL if the text mentions a call, else SONG if it mentions a song, else UNKNOWN."""
    t = F.lower(_col(kind))
    return F.when(F.contains(t, F.lit("call")), "CALL").when(F.contains(t, F.lit("song")), "SONG").otherwise("UNKNOWN")


def has_vocalization_prefix(name: Column | str) -> Column:
    n = base_name(name)
    return F.startswith(n, F.lit("CALL")) | F.startswith(n, F.lit("SONG"))


def ensure_vocalization_prefix(name: Column | str, kind: Column | str) -> Column:
    """The file name with its type in front, once; UNKNOWN_ gives way to a type that has become known."""
    n = _col(name)
    plain = F.regexp_replace(n, "^UNKNOWN_", "")
    return F.when(has_vocalization_prefix(n), n).otherwise(F.concat(vocalization_type(kind), F.lit("_"), plain))


def phylo_name(genus: Column | str, species: Column | str) -> Column:
    return F.concat(_col(genus), _col(species))


def full_name(genus: Column | str, species: Column | str, ident: Column | str) -> Column:
    return F.concat(phylo_name(genus, species), F.lit("_xc"), _col(ident).cast("string"))


def snippet_name(path: Column | str, start: Column | str) -> Column:
    return F.concat(stem(path), F.lit("_sw-start"), F.bround(_col(start), 0).cast("long").cast("string"), F.lit(".png"))


def species_copy_name(snippet: Column | str, species: Column | str) -> Column:
    """The name of a snippet's copy for a further species: <stem>_<species>.png, spaces in the species as '_'."""
    return F.concat(stem(snippet), F.lit("_"), F.translate(_col(species), " ", "_"), F.lit(".png"))


def serial_number(path: Column | str) -> Column:
    """Last '_' token of the stem as an integer, else null."""
    return F.try_to_number(F.regexp_extract(F.element_at(F.split(stem(path), "_"), -1), r"^([0-9]{1,18})$", 1), F.lit("999999999999999999")).cast("long")


def log_name_parts(name: Column | str) -> Column:
    """struct(kernel_size, batch_size) of ...K<n>_B<m>.jsonl."""
    part = lambda i: F.regexp_extract(_col(name), r"K(\d+)_B(\d+)", i)
    num = lambda i: F.when(part(i) != "", part(i)).cast("int")
    return F.struct(num(1).alias("kernel_size"), num(2).alias("batch_size"))


def parse_run_filename(name: Column | str) -> Column:
    """Typed struct of the known key_value pairs in a file name; missing or malformed ones are null."""
    parts = F.split(stem(name), "_")

    def value(key: str, kind: str) -> Column:
        at = F.array_position(parts, key).cast("int")
        text = F.when(at > 0, F.try_element_at(parts, at + 1))
        if kind == "boolean":
            return F.when(text.isNotNull(), text.isin(*TRUE_TEXTS))
        return text if kind == "string" else text.try_cast(kind)

    return F.struct(*[value(k, t).alias(k) for k, t in RUN_PROPERTIES.items()])


def run_timestamp(name: Column | str) -> Column:
    found = F.regexp_extract(base_name(name), r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}_[0-9]{2}_[0-9]{2})", 1)
    return F.when(found != "", found)


def run_filename(prefix: str, properties: dict[str, Column], suffix_: str = "") -> Column:
    """prefix_key_value...suffix of the known keys, in the order given."""
    parts = [F.lit(prefix)]
    for key, value in properties.items():
        if key in RUN_PROPERTIES:
            text = F.when(value.cast("boolean"), "True").otherwise("False") if RUN_PROPERTIES[key] == "boolean" else value.cast("string")
            parts += [F.lit(key), F.coalesce(text, F.lit("na"))]
    return F.concat(F.concat_ws("_", *parts), F.lit(suffix_))


def ellipsed_path(path: Column | str, acceptable: int = 25) -> Column:
    """First directory and file name stay; directories after the first go, from the left, until the rest fits; '...' stands in the middle."""
    p = _col(path)
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    n = F.size(parts)
    lead = F.when(F.startswith(p, F.lit("/")), "/").otherwise("")
    first, name = F.element_at(parts, 1), F.element_at(parts, -1)
    rest = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda k: F.concat(F.array(first), F.slice(parts, k + 2, F.greatest(n - 1 - k, F.lit(1)))))
    fits = F.filter(rest, lambda r: F.length(F.array_join(r, "/")) <= acceptable)
    taken = F.coalesce(F.try_element_at(fits, F.lit(1)), F.element_at(rest, -1))
    half = F.floor(F.size(taken) / 2).cast("int")
    short = F.concat(lead, F.array_join(F.concat(F.slice(taken, F.lit(1), half), F.array(F.lit("...")), F.slice(taken, half + 1, F.size(taken) - half)), "/"))
    return F.when((F.length(p) <= acceptable) | (n < 2), p).when(F.length(name) >= acceptable, F.concat(lead, first, F.lit("/..."), name)).when(n < 3, p).otherwise(short)


# ---- small conversions ------------------------------------------------------
def str2bool(s: Column | str) -> Column:
    return F.coalesce(_col(s).isin(*TRUE_TEXTS), F.lit(False))


def split_list(s: Column | str) -> Column:
    """Comma list to trimmed texts; empty text to an empty array; a bracketed list is null."""
    t = F.trim(_col(s))
    items = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(~F.rlike(t, F.lit(r"^[\[(]")), items)


def minutes_seconds(text: Column | str) -> Column:
    """m:ss or h:mm:ss as seconds."""
    parts = F.transform(F.split(_col(text), ":"), lambda x: x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)


def duration_text(seconds: Column | str, granularity: int = 2) -> Column:
    """'1.0 week, 2.0 days' and so on: the first parts that aren't zero; under a second '< 1sec>'."""
    left = F.floor(_col(seconds)).cast("long")
    parts = []
    for name, size in (("weeks", 604800), ("days", 86400), ("hours", 3600), ("minutes", 60), ("seconds", 1)):
        n = F.floor(left / size)
        parts.append(F.when(n > 0, F.concat(n.cast("double").cast("string"), F.when(n == 1, f" {name[:-1]}").otherwise(f" {name}"))))
        left = left - n * size
    return F.when(F.floor(_col(seconds)) < 1, "< 1sec>").otherwise(F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, granularity), ", "))


def bytes_text(n: Column | str, suffix_: str = "B") -> Column:
    """1536 -> 1.5KB."""
    x = _col(n).cast("double")
    units = ["", "K", "M", "G", "T", "P", "E", "Z"]
    out = F.concat(F.format_number(x / float(1024**8), 1), F.lit("Yi" + suffix_))
    for i in reversed(range(len(units))):
        out = F.when(F.abs(x) < float(1024 ** (i + 1)), F.concat(F.format_string("%3.1f", x / float(1024**i)), F.lit(units[i] + suffix_))).otherwise(out)
    return F.trim(out)


def file_timestamp(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH_mm_ss")


def step_number(epoch: Column | str, split: Column | str, folds: int) -> Column:
    return _col(epoch) * folds + _col(split)


# ---- numbers and arrays -----------------------------------------------------
def interval_contains(low: Column | str, high: Column | str, x: Column | str) -> Column:
    return (_col(low) <= _col(x)) & (_col(x) < _col(high))


def argmax(scores: Column | str) -> Column:
    """Position from 0 of the largest score, the first of ties."""
    return (F.array_position(_col(scores), F.array_max(_col(scores))) - 1).cast("int")


def softmax(scores: Column | str) -> Column:
    s = _col(scores)
    top = F.array_max(s)
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top.cast("double")))
    return F.transform(s, lambda x: F.exp(x.cast("double") - top.cast("double")) / total)


def one_hot(label: Column | str, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == _col(label)).cast("int"))


def minmax_scale(a: Column | str, lo: float, hi: float) -> Column:
    """Linear to lo..hi; of a constant array null."""
    x = _col(a)
    least, most = F.array_min(x).cast("double"), F.array_max(x).cast("double")
    return F.when(most > least, F.transform(x, lambda v: (v.cast("double") - least) / (most - least) * (hi - lo) + lo))


def rms(a: Column | str) -> Column:
    x = _col(a)
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")) / F.size(x))


def noise_gain(signal: Column | str, noise: Column | str, snr_db: Column | float) -> Column:
    """Factor that puts the noise snr_db decibels below the signal."""
    s = snr_db if isinstance(snr_db, Column) else F.lit(float(snr_db))
    return rms(signal) / F.pow(F.lit(10.0), s / 20) / rms(noise)


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    return -F.ln(F.element_at(softmax(logits), _col(label).cast("int") + 1))


def mean_squared_error(scores: Column | str, target: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(scores), _col(target), lambda a, b: F.pow(a - b, F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x) / F.size(_col(scores))


# ---- maps and records -------------------------------------------------------
def map_update(old: Column | str, new: Column | str) -> Column:
    """Entries of both maps; where both have a key, the new value."""
    o, n = _col(old), _col(new)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


def map_clear() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def to_record(*columns: str) -> Column:
    """JSON object of string columns; nulls are left out."""
    return F.to_json(F.struct(*columns))

"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.strip and str.split take for white space.
PY_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"


def strip(c: Column) -> Column:
    """str.strip()."""
    return F.regexp_replace(c, rf"\A{PY_SPACE}+|{PY_SPACE}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{PY_SPACE}+", "")


def words(c: Column) -> Column:
    """str.split(): white-space separated words, none for an empty text."""
    return F.filter(F.split(c, rf"{PY_SPACE}+"), lambda w: w != "")


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def ngrams(ws: Column, n: int) -> Column:
    """All runs of n words, joined by a space. The words are computed once for all runs."""

    def runs(w: Column) -> Column:
        count = F.size(w) - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(ws), runs)[0]


def before(c: Column, mark: str) -> Column:
    """The text before the first mark, or all of it."""
    return F.substring_index(c, mark, 1)


def after_last(c: Column, mark: str) -> Column:
    """The text behind the last mark, or all of it."""
    return F.substring_index(c, mark, -1)


def seeded_index(n: int | Column, seed: int, *key: Column) -> Column:
    """A number below n that depends on seed and key only: the library's stand-in for an unseeded random choice."""
    n = F.lit(n) if isinstance(n, int) else n
    h = F.conv(F.substring(F.md5(F.concat_ws("-", *[k.cast("string") for k in key], F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, n).cast("int")


def seeded_choice(options: Column, seed: int, *key: Column) -> Column:
    """One element of an array by seed and key; null of an empty one."""
    return F.try_element_at(options, seeded_index(F.greatest(F.size(options), F.lit(1)), seed, *key) + 1)


def printable(c: Column, most: int = 100) -> Column:
    """A text of more than `most` characters shortened to its ends."""
    half = most // 2
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, half), F.lit("..."), F.right(c, F.lit(half)))).otherwise(c)


def media_type(name: Column) -> Column:
    """video, image or audio by a file name's extension; others raise."""
    kinds = {
        "image": ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff"),
        "video": ("mp4", "mkv", "avi", "mov", "webm", "flv", "wmv"),
        "audio": ("mp3", "wav", "flac", "aac", "ogg", "m4a"),
    }
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))
    out = F.raise_error(F.concat(F.lit("unknown media type: "), F.coalesce(name, F.lit("null")))).cast("string")
    for kind, known in kinds.items():
        out = F.when(ext.isin(*known), kind).otherwise(out)
    return out


def first_scalar(c: Column, kind) -> Column:
    """The first scalar of nested arrays and structs; null where one on the way is empty."""
    from pyspark.sql import types as T

    while isinstance(kind, (T.ArrayType, T.StructType)):
        c, kind = (F.get(c, 0), kind.elementType) if isinstance(kind, T.ArrayType) else (c[kind.names[0]], kind.fields[0].dataType)
    return c


def lower_bound(values: Column, reached, most: int = 1 << 30) -> Column:
    """The first index of an array at which reached(element) holds, given that it holds from some index on; the array's size
    where it never does. Bisection: the steps are powers of two."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(values)) & ~F.coalesce(reached(F.get(values, at + step - 1)), F.lit(True)), at + step).otherwise(at))

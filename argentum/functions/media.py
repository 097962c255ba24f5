"""Scalar functions on media metadata, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.operators.predicates import BLANKS

#: Prefix of stored pictures, what is shown without a name, least mean confidence of a text.
DATA_URL = "data:image/jpeg;base64,"
UNNAMED = "圖片"
LEAST_CONFIDENCE = 20.0


def exif_datetime(tag: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a camera's date tag, or null; the day is not checked against the month."""
    parts = F.filter(F.split(F.regexp_replace(tag, "^[ \"\\x00]+|[ \"\\x00]+$", ""), "[-: T]"), lambda p: p != "")
    n = F.transform(F.slice(parts, 1, 6), lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("bigint")))
    within = F.size(n) == 6
    for k, (low, high) in enumerate([(1900, 2200), (1, 12), (1, 31), (0, 23), (0, 59), (0, 60)]):
        within &= F.coalesce(F.get(n, F.lit(k)).between(low, high), F.lit(False))
    pad = lambda k, width: F.lpad(F.get(n, F.lit(k)).cast("string"), width, "0")
    return F.when(
        within,
        F.concat(pad(0, 4), F.lit("-"), pad(1, 2), F.lit("-"), pad(2, 2), F.lit(" "), pad(3, 2), F.lit(":"), pad(4, 2), F.lit(":"), pad(5, 2)),
    )


def thumbnail_width(width: Column, height: Column, bound: int = 480) -> Column:
    return F.when(width >= height, F.lit(bound)).otherwise(F.greatest(F.expr("1"), F.floor((width * bound + F.floor(height / 2)) / height))).cast("long")


def thumbnail_height(width: Column, height: Column, bound: int = 480) -> Column:
    return F.when(width >= height, F.greatest(F.expr("1"), F.floor((height * bound + F.floor(width / 2)) / width))).otherwise(F.lit(bound)).cast("long")


def ocr_side(width: Column, height: Column) -> Column:
    """The longest side for text recognition: small images are enlarged, huge ones reduced."""
    side = F.greatest(width, height)
    return F.when(side < 1800, F.least(side * 2, F.lit(2600))).otherwise(F.least(side, F.lit(3200))).cast("long")


def to_data_url(content: Column) -> Column:
    return F.concat(F.lit(DATA_URL), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def from_data_url(url: Column) -> Column:
    """The bytes; null without the exact prefix, or where what follows isn't padded base64."""
    body = F.substring(url, len(DATA_URL) + 1, 2**31 - 1 - len(DATA_URL))
    good = url.startswith(DATA_URL) & (F.length(body) % 4 == 0) & body.rlike("^[A-Za-z0-9+/]*([AQgw]==|[AEIMQUYcgkosw048]=)?$")
    return F.when(good, F.try_to_binary(body, F.lit("base64")))


def first_datetime(tags: list[Column]) -> Column:
    """The first of several date tags (original, digitised, changed) that can be read."""
    return F.coalesce(*[exif_datetime(t) for t in tags])


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of boxes (left, top, right, bottom) over their union; 0 if that is empty."""
    zero = F.lit(0.0)
    area = lambda x: F.greatest(x[2] - x[0], zero) * F.greatest(x[3] - x[1], zero)
    shared = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(
        F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero
    )
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(zero)


def filename(path: Column) -> Column:
    """The last part of a path; one without has the name ``圖片``."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.isin("", ".", "..") | last.isNull(), UNNAMED).otherwise(last)


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """0 when all is done, null before anything can be told."""
    return (
        F.when((total > 0) & (done >= total), F.lit(0))
        .when((done == 0) | (elapsed < 0.5), F.lit(None))
        .otherwise(F.ceil((total - done) * elapsed / done))
        .cast("long")
    )


def utf16_prefix(text: Column, units: int) -> Column:
    """The first code points of a text that fit into so many UTF-16 units; half a pair is left out."""
    short = F.substring(text, 1, units)
    width = lambda c: F.when(c.rlike("[\\x{10000}-\\x{10FFFF}]"), 2).otherwise(1)
    fitting = F.aggregate(
        F.split(short, ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept")),
        lambda acc, c: F.when(
            (c != "") & (acc["n"] + width(c) <= units), F.struct((acc["n"] + width(c)).alias("n"), (acc["kept"] + 1).alias("kept"))
        ).otherwise(F.struct(F.lit(units + 1).alias("n"), acc["kept"].alias("kept"))),
        lambda acc: acc["kept"],
    )
    return F.when(short.rlike("[\\x{10000}-\\x{10FFFF}]"), F.substring(short, F.lit(1), fitting)).otherwise(short)


def size_text(width: Column, height: Column) -> Column:
    """``w × h``, or ``圖片`` where a side isn't known."""
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.when(known, F.concat_ws(" × ", width.cast("string"), height.cast("string"))).otherwise(UNNAMED)


def card(text: Column, people: Column, width: Column, height: Column, captured_at: Column) -> Column:
    """What a result shows under its picture: size, capture time, people and the first hundred units of the text.

    Parts that are missing are left out; there is always a size.
    """
    part = lambda value, prefix="": F.when(value != "", F.concat(F.lit(prefix), value))
    return F.concat_ws(
        " | ",
        size_text(width, height),
        part(captured_at, "拍攝："),
        part(F.array_join(people, "、")),
        part(utf16_prefix(text, 100), "OCR："),
    )


def eta_text(seconds: Column, finish: Column | None = None) -> Column:
    """The remaining time in words; ``finish`` is the clock time to name, if any."""
    h, m, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    part = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    left = (
        F.when(seconds >= 3600, F.concat(part(h, " 小時 "), part(m, " 分鐘")))
        .when(seconds >= 60, F.concat(part(m, " 分鐘 "), part(rest, " 秒")))
        .otherwise(part(rest, " 秒"))
    )
    end = F.lit("") if finish is None else F.concat(F.lit("（約 "), finish, F.lit(" 完成）"))
    return F.when(seconds.isNull(), "正在估算完成時間…").when(seconds <= 0, "即將完成").otherwise(F.concat(F.lit("預估剩餘 "), left, end))


def clock_text(second_of_day: Column) -> Column:
    """``上午`` or ``下午`` with hours from 1 to 12 and minutes."""
    hour = F.floor(second_of_day / 3600)
    return F.concat(
        F.when(hour < 12, "上午").otherwise("下午"), F.format_string("%02d:%02d", F.pmod(hour + 11, F.lit(12)) + 1, F.floor(second_of_day % 3600 / 60))
    )


def tsv_words(output: Column) -> Column:
    """(place, word, confidence) of a recogniser's tab-separated output; the first line is its header.

    A line has twelve fields at least, the last of which keeps further tabs.  Blank words are left
    out; a confidence that isn't a number from 0 up is null.
    """
    lines = F.split(F.regexp_replace(output, "\r\n", "\n"), "\n")
    lines = F.slice(lines, 2, F.size(lines))
    fields = F.transform(lines, lambda line, place: F.struct(place.alias("place"), F.split(line, "\t", 12).alias("f")))
    trimmed = lambda f: F.regexp_replace(F.get(f, F.lit(11)), f"^{BLANKS}|{BLANKS}$", "")
    number = lambda f: F.when(F.get(f, F.lit(10)).rlike("^[^ ]+$"), F.get(f, F.lit(10)).try_cast("float"))
    words = F.transform(
        F.filter(fields, lambda x: F.size(x["f"]) >= 12),
        lambda x: F.struct(
            x["place"], trimmed(x["f"]).alias("word"), F.when((number(x["f"]) >= 0) & ~F.isnan(number(x["f"])), number(x["f"])).alias("confidence")
        ),
    )
    return F.filter(words, lambda w: w["word"] != "")


def tsv_text(output: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """struct(text, confidence) of a recogniser's output, or null: no words, or a mean confidence below ``least``.

    Without any known confidence it is 0 and the text stays.
    """
    words = F.filter(F.array(tsv_words(output)), lambda w: F.size(w) > 0)
    read = F.transform(
        words,
        lambda w: F.transform(
            F.array(F.filter(F.transform(w, lambda x: x["confidence"]), lambda c: c.isNotNull())),
            lambda known: F.struct(
                F.array_join(F.transform(w, lambda x: x["word"]), " ").alias("text"),
                F.when(F.size(known) == 0, 0.0)
                .otherwise(F.aggregate(known, F.lit(0.0), lambda a, c: a + c.cast("double")) / F.size(known))
                .alias("confidence"),
                (F.size(known) > 0).alias("counted"),
            ),
        )[0],
    )
    good = F.filter(read, lambda r: ~r["counted"] | (r["confidence"] >= least))
    return F.get(F.transform(good, lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence"))), F.lit(0))


def words_of_page(words: DataFrame, key: str, place: str, word: str, confidence: str, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(key, text, confidence) of recognised words, in their order.

    Words without a confidence (below 0) count for the text alone; a page whose mean
    confidence is below ``least`` has no text.
    """
    known = F.when(F.col(confidence) >= 0, F.col(confidence))
    pages = words.where(F.trim(word) != "").groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, word))), lambda w: w[word]), " ").alias("text"),
        F.avg(known).alias("confidence"),
    )
    return pages.where(F.col("confidence").isNull() | (F.col("confidence") >= least))


def best_candidate(candidates: DataFrame, key: str, place: str, text: str, confidence: str) -> DataFrame:
    """(key, text): of several readings the one with the best confidence, longer texts a little ahead; of equal ones the last."""
    rank = F.col(confidence) + 0.08 * F.least(F.char_length(text), F.lit(200))
    return candidates.groupBy(key).agg(F.coalesce(F.max_by(text, F.struct(rank.alias("rank"), place, text)), F.lit("")).alias("text"))

"""Classification by ordered rules, buckets, lumping and text filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Platforms by patterns of the lower-cased address, the first that fits.
PLATFORMS = (
    ("YouTube", r"youtu\.be|youtube\.com|utube\.com"),
    ("Facebook", r"facebook\.com|fb\.watch"),
    ("Instagram", r"instagram\.com"),
    ("TikTok", r"tiktok\.com"),
    ("Official site", r"\.army"),
    ("Fundraising", r"monobank|buymeacoffee|whitepay|forms\.gle|dignitas\.fund|marikatefund"),
    ("Telegram", r"t\.me/"),
)
#: Fundraising services by what the address contains.
FUNDRAISING = (("Monobank", "monobank"), ("BuyMeACoffee", "buymeacoffee"), ("WhitePay", "whitepay"), ("Google Forms", "forms.gle"), ("Dignitas", "dignitas"), ("Marikatefund", "marikatefund"))
#: How a text names the bank that has no address, and the address that stands for it.
BANK = "приватбанк|privatbank"
BANK_ROW = "privatbank-text"
#: Platforms that a lower-cased text names.
PLATFORM_MENTIONS = (
    ("YouTube", r"youtube|youtu\.be|ютуб"),
    ("Facebook", r"facebook|fb\.watch|фейсбук|фесбук"),
    ("Instagram", "instagram|інстаграм|инстаграм"),
    ("TikTok", "tiktok|тік.ток|тик.ток"),
    ("Telegram", r"telegram|телеграм|t\.me/"),
    ("Official site", r"\.army|sbs.?group"),
    ("Fundraising", r"monobank|монобанк|buymeacoffee|whitepay|приватбанк|privatbank|forms\.gle|dignitas|marikatefund"),
)
#: Mentions in lower-cased text, and a wallet that is looked for in the text as it is.
MENTIONS = (
    ("Monobank", "monobank|монобанк"),
    ("PrivatBank", "приватбанк|privatbank"),
    ("BuyMeACoffee", "buymeacoffee"),
    ("WhitePay", "whitepay"),
    ("Google Forms", r"forms\.gle"),
    ("PayPal", "paypal"),
    ("Oschadbank", r"ощадбанк|oschadbank|1020[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}"),
    ("IBAN", "ua[0-9]{25,27}"),
    ("Dignitas", "dignitas"),
    ("Marikatefund", "marikatefund"),
)
WALLET = "T[A-Za-z0-9]{33}"


def first_match(text: Column, rules: Sequence[tuple[str, str]], contains: bool = False) -> Column:
    """The label of the first rule that fits the lower-cased text, else null."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(F.contains(low, F.lit(pattern)) if contains else low.rlike(pattern), label).otherwise(out)
    return out


def with_bank_mentions(rows: DataFrame, key: str, url: str, text: str, pattern: str = BANK) -> DataFrame:
    """`rows` with their fundraising service, and a row more with the address BANK_ROW for each key whose text names the bank and none of whose addresses is a fundraising service's."""
    served = rows.withColumn("service", fundraising(F.col(url)))
    known = served.where("service is not null").select(key).distinct()
    named = rows.where(F.lower(text).rlike(pattern)).join(known, key, "left_anti").dropDuplicates([key]).withColumn(url, F.lit(BANK_ROW))
    return served.unionByName(named.withColumn("service", fundraising(F.col(url))))


def fundraising(url: Column) -> Column:
    """The service of an address."""
    return F.coalesce(first_match(url, FUNDRAISING, contains=True), F.when(F.lower(url) == BANK_ROW, "PrivatBank"))


def mentions(rows: DataFrame, key: str, text: Column, rules: Sequence[tuple[str, str]] = MENTIONS, exact: Sequence[tuple[str, str]] = (("USDT", WALLET),)) -> DataFrame:
    """(key, category) for each category that a text mentions, once. The rules are tried in the row: no join."""
    low = F.lower(text)
    found = [F.when(low.rlike(p), label) for label, p in rules] + [F.when(text.rlike(p), label) for label, p in exact]
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("category")).distinct()


def ratio_class(ratio: Column) -> Column:
    """Absent (0), partial (up to .5), dominant."""
    return F.when(ratio == 0, "absent").when(ratio <= 0.5, "partial").when(ratio.isNotNull(), "dominant")


def lump(rows: DataFrame, category: str, top: int, other: str = "Autres") -> DataFrame:
    """`category` with all but its `top` commonest values (then by name) replaced. The list is at most `top` rows."""
    kept = rows.where(F.col(category).isNotNull()).groupBy(category).count().orderBy(F.desc("count"), category).limit(top)
    kept = kept.select(F.col(category).alias("kept_"))
    joined = rows.join(F.broadcast(kept), F.col(category) == F.col("kept_"), "left")
    shown = F.when(F.col(category).isNotNull(), F.coalesce("kept_", F.lit(other)))
    return joined.withColumn(category, shown).drop("kept_")


def branding(content: Column, watermark: Column, strong: str, second: str, name: str, other: str = ".") -> Column:
    """The first label that fits: strong, second (in either text), the name (in the watermark), other text, none."""
    both = F.concat_ws(" ", content, watermark)
    return F.when(both.rlike(strong), "strong").when(both.rlike(second), "second").when(watermark.rlike(name), "name").when(both.rlike(other), "other").otherwise("none")


def codec_family(codec: Column) -> Column:
    """P18."""
    low = F.lower(codec)
    return F.when(low.rlike("h264|avc"), "H.264").when(low.rlike("hevc|h265"), "H.265").when(low.rlike("vp8|vp9|av1"), "VPx/AV1").when(low.isNotNull(), "other")


def is_album(album: Column) -> Column:
    """Null, blank and the text NA are no album."""
    return F.coalesce(~F.trim(album).isin("", "NA"), F.lit(False))


def image_format(width: Column, height: Column, buckets: Sequence[tuple[str, float, float]], other: str = "autre") -> Column:
    """The first bucket whose closed interval holds width / height, else `other`; null without sizes."""
    ratio = F.when(height > 0, width / height)
    out = F.lit(other)
    for label, low, high in reversed(buckets):
        out = F.when(ratio.between(low, high), label).otherwise(out)
    return F.when(ratio.isNotNull(), out)


def needs_translation(text: Column, least: int = 2) -> Column:
    """At least `least` Cyrillic letters."""
    return F.coalesce(F.regexp_count(text, F.lit("[Ѐ-ӿ]")) >= least, F.lit(False))


def clean_segments(segments: Column, share: float = 0.4, run: int = 4) -> Column:
    """Segments (struct with text) without a Latin run of `run` letters and with a share of non-Cyrillic letters up to `share`."""

    def fine(s):
        letters = F.regexp_count(s["text"], F.lit(r"\p{L}"))
        cyrillic = F.regexp_count(s["text"], F.lit("[Ѐ-ӿ]"))
        return ~s["text"].rlike(f"[A-Za-z]{{{run},}}") & ((letters == 0) | ((letters - cyrillic) / letters <= share))

    return F.filter(segments, fine)


def is_watermark(text: Column, box: Column, pattern: str, height: Column, edge: float = 0.15) -> Column:
    """The text fits, or the centre of its box (array of [x, y]) is in the top or bottom share of the image."""
    middle = F.aggregate(box, F.lit(0.0), lambda a, p: a + F.get(p, 1)) / F.size(box)
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False)) | (middle < edge * height) | (middle > (1 - edge) * height)


def audio_class(speech: Column, music: Column, silence: Column, least: float = 0.4) -> Column:
    """The greatest of three ratios, or mixed below `least`."""
    most = F.greatest(speech, music, silence)
    return F.when(most.isNull(), None).when(most < least, "mixte").when(most == speech, "parole").when(most == music, "musique").otherwise("silence")


def significant(p: Column, fold: Column, count: Column, level: float = 0.05, least_fold: float = 1.0, least: int = 5) -> Column:
    """The side that a lemma is typical of: b for positive folds, a for negative, ns if not significant."""
    ok = (p < level) & (F.abs(fold) >= least_fold) & (count >= least)
    return F.when(ok & (fold > 0), "b").when(ok, "a").otherwise("ns")


def translate(rows: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """`column` replaced by the dictionary's value (from, to); a word that it lacks stays. The dictionary is a small dimension."""
    names = dictionary.select(F.col("from").alias("from_"), F.col("to").alias("to_"))
    return rows.join(names, F.col(column) == F.col("from_"), "left").withColumn(column, F.coalesce("to_", column)).drop("from_", "to_")

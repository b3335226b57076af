"""Scalar functions of media metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is read of a probe's JSON, and the codecs of still images.
PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string,bit_rate:string>>, "
    "format struct<duration:string,size:string,bit_rate:string>"
)
IMAGE_CODECS = ("mjpeg", "png", "webp", "bmp", "gif", "tiff")


def frames_per_second(text: Column) -> Column:
    """A fraction like 30000/1001 to 2 decimals; null for a zero denominator."""
    up, down = (F.try_to_number(F.split_part(text, F.lit("/"), F.lit(i)), F.lit("9999999999")).cast("double") for i in (1, 2))
    return F.when(F.contains(text, F.lit("/")), F.when(down > 0, F.round(up / down, 2))).otherwise(text.try_cast("double"))


def probe(text: Column) -> Column:
    """a struct of fields from a probe's JSON: the first video and audio stream, duration of the format or else the stream, kbps."""
    j = F.from_json(text, PROBE)
    first = lambda kind: F.get(F.filter(j["streams"], lambda s: s["codec_type"] == kind), 0)
    video, audio = first("video"), first("audio")
    image = F.coalesce(video["codec_name"].isin(*IMAGE_CODECS), F.lit(False))
    duration = F.coalesce(j["format"]["duration"].try_cast("double"), video["duration"].try_cast("double"), audio["duration"].try_cast("double"))
    moving = lambda x: F.when(video.isNotNull() & ~image, x)
    rate = F.coalesce(video["bit_rate"].try_cast("double"), j["format"]["bit_rate"].try_cast("double"))
    width, height = video["width"], video["height"]
    shape = F.when(width > height, "horizontal").when(width < height, "vertical").when(width == height, "square")
    return F.struct(
        F.when(~image, F.round(duration, 2)).alias("duree"), width.alias("largeur"), height.alias("hauteur"), shape.alias("orientation"),
        moving(F.bround(rate / 1000).cast("int")).alias("video_bitrate"), moving(F.coalesce(frames_per_second(video["avg_frame_rate"]), frames_per_second(video["r_frame_rate"]))).alias("fps"),
        audio.isNotNull().alias("audio_present"), j["format"]["size"].try_cast("bigint").alias("fichier_taille"),
    )


def frame_index(name: Column, default: int = 1) -> Column:
    """the number in _kf_<number> of a file name."""
    return F.coalesce(F.regexp_extract(name, r"_kf_(\d+)", 1).try_cast("int"), F.lit(default))


def relative_position(index: Column, count: Column) -> Column:
    """The place from 0 to 1 among `count` frames, 0 for a single one. index counts from 1."""
    return F.when(count > 1, (index - 1) / (count - 1)).otherwise(0.0)


def middle(items: Column) -> Column:
    """The item at place n div 2 (from 0) of the sorted array."""
    return F.get(F.array_sort(items), F.floor(F.size(items) / 2).cast("int"))


def resolution(width: Column, height: Column) -> Column:
    """WxH."""
    return F.concat_ws("x", width.cast("string"), height.cast("string"))


def megabytes(size: Column) -> Column:
    return size / (1024.0 * 1024.0)


def softmax_pair(positive: Column, negative: Column, scale: float = 100.0) -> Column:
    """The share of the positive prompt of a pair of logits."""
    return 1 / (1 + F.exp(scale * (negative - positive)))


def media_name(key: Column, rank: Column, when: Column, extension: Column) -> Column:
    """The deterministic file name of a message's media."""
    return F.concat(F.date_format(when, "yyyyMMdd'_'HHmmss"), F.lit("_"), key.cast("string"), F.when(rank > 1, F.concat(F.lit("_"), rank.cast("string"))).otherwise(""), extension)


def message_row(api: Column) -> Column:
    """An API message (struct) to base fields: the largest photo by area, else the video's attributes; blank captions are null."""
    size = F.array_max(F.transform(api["photo_sizes"], lambda s: F.struct((s["w"] * s["h"]).alias("area"), s["w"].alias("w"), s["h"].alias("h"))))
    return F.struct(
        api["id"].alias("message_id"), F.date_format(api["date"], "yyyy-MM-dd'T'HH:mm:ss").alias("date"), api["grouped_id"].cast("string").alias("album_id"),
        api["fwd_from"].isNotNull().alias("est_transfere"), F.nullif(api["message"], F.lit("")).alias("legende"),
        F.coalesce(size["w"], api["video"]["w"]).alias("largeur"), F.coalesce(size["h"], api["video"]["h"]).alias("hauteur"), api["video"]["duration"].alias("duree"), api["views"].alias("vues"), api["forwards"].alias("transferts"),
    )

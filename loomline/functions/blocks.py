"""Content blocks of posts and media objects as typed columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomline.functions.markup import rich
from loomline.functions.records import block_level, first_of
from loomline.functions.text import unwrap_url

# Pages of a video by the service that hosts it; %s is its id.
VIDEO_PAGES = {
    "youtube": "https://www.youtube.com/watch?v=%s",
    "vimeo": "https://vimeo.com/%s",
    "coub": "https://coub.com/view/%s",
    "twitch": "https://www.twitch.tv/videos/%s",
    "vk": "https://vk.com/video%s",
    "rutube": "https://rutube.ru/video/%s/",
}
# The formats of media that move, and the heading levels by style.
MOVING = ("gif", "mp4", "webm", "mov")
HEADINGS = {"h1": 2, "h2": 2, "h3": 3, "h4": 4, "h5": 4, "h6": 4}

MEDIA = "struct<key:string,kind:string,width:int,height:int,duration:double,format:string,size:bigint,name:string>"
BLOCK = ("text", "author", "style", "title", "description", "url", "hostname", "service", "video_id", "lang", "date", "duration", "ref_id", "heading", "ordered", "items", "media", "error")


def get(data: Column, path: str, kind: str = "string") -> Column:
    """A value of a variant; null where it is missing or of another kind."""
    return F.try_variant_get(data, f"$.{path}", kind)


def video_page(service: Column, video: Column, at: Column, other: Column) -> Column:
    """The page of a video: of a known service by its id, else the address given."""
    page = F.lit(None).cast("string")
    for name, shape in VIDEO_PAGES.items():
        before, after = shape.split("%s")
        made = F.concat(F.lit(before), video, F.lit(after))
        page = F.when(service == name, F.concat(made, F.when(at.cast("int") > 0, F.concat(F.lit("&t="), at.cast("int"), F.lit("s"))).otherwise("")) if name == "youtube" else made).otherwise(page)
    return F.when(F.length(video) > 0, F.coalesce(page, other)).otherwise(other)


def media_info(obj: Column, cdn: str = "") -> Column:
    """A media object ({type, data} or the data alone) as a struct; null without a uuid. The kind is that of the mime type if one is known
    (column mime of the object), else it follows from the type flags."""
    inner = lambda name, kind="string": F.coalesce(get(obj, f"data.{name}", kind), F.when(get(obj, "data", "variant").isNull(), get(obj, name, kind)))
    uuid = inner("uuid")
    key = F.when(uuid.startswith("http"), F.when(uuid.startswith(cdn) if cdn else F.lit(False), uuid)).otherwise(F.lower(uuid))
    form = F.lower(F.coalesce(inner("type"), F.lit("")))
    of = F.when(get(obj, "data", "variant").isNotNull(), get(obj, "type"))
    mime = F.split_part(F.coalesce(inner("mime"), F.lit("")), F.lit("/"), F.lit(1))
    moving = form.isin(*MOVING) | F.coalesce(inner("isVideo", "boolean"), F.lit(False)) | F.coalesce(of.isin("movie", "video"), F.lit(False))
    kind = F.when(mime.isin("video", "audio", "image"), mime).when(mime != "", "file").when(moving, "video").when(of.isin("audio", "file"), of).otherwise("image")
    number = lambda name, kind: inner(name).try_cast(kind)
    info = F.struct(
        key.alias("key"), kind.alias("kind"), number("width", "int").alias("width"), number("height", "int").alias("height"), number("duration", "double").alias("duration"),
        F.nullif(form, F.lit("")).alias("format"), number("size", "bigint").alias("size"), first_of(inner("name"), inner("title")).alias("name"),
    )
    return F.when(F.length(key) > 0, info).cast(MEDIA)


@F.pandas_udf(ArrayType(StringType()))
def plain(markup: pd.Series) -> pd.Series:
    """Each string of an array without its markup."""
    return pd.Series([None if a is None else [None if x is None else rich(x)["text"] for x in a] for a in markup], dtype=object)


def normalised(blocks: DataFrame) -> DataFrame:
    """blocks: post_id, idx, type, data (variant) -> post_id, idx, type, level and the columns BLOCK: what a block of any type says, without markup.
    A block that lacks what its type needs has error and nothing else; one of an unknown type keeps its JSON in raw.

    items are the entries of a list or the options of a quiz (an array or an object); media are all media objects of the block in order; url is
    the link's, embed's, button's or video's address without redirections; ref_id is the post that an embed points to."""
    d, kind = F.col("data"), F.coalesce("type", F.lit("?"))
    link, embed, video = (F.coalesce(get(d, f"{n}.data", "variant"), get(d, n, "variant")) for n in ("link", "osnovaEmbed", "video"))
    telegram = F.coalesce(get(d, "telegram.data.tg_data", "variant"), get(d, "telegram.tg_data", "variant"))
    subject = F.when(kind == "link", link).when(kind == "osnovaEmbed", embed).when(kind == "telegram", telegram).otherwise(d)
    service = F.when(kind == "video", F.lower(get(video, "external_service.name")))
    video_id = F.when(kind == "video", get(video, "external_service.id"))
    button = first_of(get(d, "url"), get(d, "link"), get(d, "href"), get(d, "url.url"), get(d, "link.url"), get(d, "href.url"))
    address = F.when(kind == "video", F.when(service.isNotNull(), video_page(service, video_id, get(video, "time", "double"), get(video, "url")))).when(kind.isin("special_button", "telegram_button"), button).otherwise(get(subject, "url"))
    sub = F.concat_ws(", ", F.nullif(get(d, "subline1"), F.lit("")), F.nullif(get(d, "subline2"), F.lit("")))
    author = F.when(kind == "quote", F.nullif(sub, F.lit(""))).when(kind == "telegram", get(telegram, "author.name")).when(kind == "osnovaEmbed", first_of(get(embed, "subsite.name"), get(embed, "author.name")))
    options = F.coalesce(get(d, "items", "array<string>"), F.map_values(get(d, "items", "map<string,string>")))
    pictures = F.when(kind == "media", F.transform(get(d, "items", "array<variant>"), lambda x: get(x, "image", "variant")))
    pictures = pictures.when(kind == "telegram", F.concat(F.coalesce(get(telegram, "photos", "array<variant>"), F.array().cast("array<variant>")), F.coalesce(get(telegram, "videos", "array<variant>"), F.array().cast("array<variant>"))))
    pictures = pictures.when(kind == "video", F.array(F.when(service.isNull(), get(d, "video", "variant")), get(video, "thumbnail", "variant"))).when(kind == "audio", F.array(get(d, "audio", "variant"), get(d, "image", "variant")))
    pictures = pictures.otherwise(F.array(get(subject, "image", "variant")))
    media = F.filter(F.transform(pictures, lambda x: media_info(x)), lambda x: x.isNotNull())
    level = F.when(kind == "header", F.coalesce(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])[F.lower(F.coalesce(get(d, "style"), F.lit("h2")))], F.lit(2)))
    wide = blocks.select(
        "post_id", "idx", kind.alias("type"), block_level(kind).alias("level"), F.to_json("data").alias("raw"),
        F.concat(F.array(get(subject, "text"), author, get(subject, "title"), get(subject, "description")), F.when(kind.isin("list", "quiz"), F.coalesce(options, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).alias("markup"),
        F.when(kind == "quote", get(d, "type")).alias("style"), unwrap_url(F.nullif(address, F.lit(""))).alias("url"), get(subject, "hostname").alias("hostname"), service.alias("service"), video_id.alias("video_id"),
        F.nullif(get(d, "lang"), F.lit("")).alias("lang"), get(telegram, "datetime", "bigint").alias("date"), get(d, "audio.data.audio_info.duration", "double").alias("duration"),
        F.when(kind == "osnovaEmbed", get(embed, "original_id", "bigint")).alias("ref_id"), level.alias("heading"), F.when(kind == "list", F.upper(F.coalesce(get(d, "type"), F.lit("UL"))) == "OL").alias("ordered"), media.alias("media"),
    ).withColumn("said", plain("markup"))
    said = lambda k: F.nullif(F.element_at("said", F.lit(k)), F.lit(""))
    lacks = F.when(F.col("type") == "link", F.col("url").isNull()).when(F.col("type") == "video", F.col("service").isNull() & (F.size("media") == 0)).when(F.col("type") == "audio", F.size("media") == 0)
    lacks = lacks.when(F.col("type").isin("special_button", "telegram_button"), F.col("url").isNull()).when(F.col("type") == "telegram", F.col("raw").isNull() | (F.size("media") == 0) & said(1).isNull() & F.col("url").isNull()).otherwise(F.lit(False))
    out = wide.withColumns({
        "text": F.when(F.col("type") == "code", F.element_at("markup", 1)).otherwise(said(1)), "author": said(2), "title": said(3), "description": said(4),
        "items": F.when(F.col("type").isin("list", "quiz"), F.slice("said", F.lit(5), F.greatest(F.size("said") - 4, F.lit(0)))), "error": lacks,
    })
    emptied = [F.when(~F.col("error"), F.col(c)).alias(c) if c != "error" else F.col(c) for c in BLOCK]
    return out.select("post_id", "idx", "type", F.when(F.col("error"), "error").otherwise(F.col("level")).alias("level"), *emptied, F.when((F.col("level") == "unsupported") | F.col("error"), F.col("raw")).alias("raw"))


def post_url(entry: Column, site: str) -> Column:
    return F.concat(F.lit(f"{site.rstrip('/')}/"), entry.cast("string"))


def comment_url(entry: Column, comment: Column, site: str) -> Column:
    return F.concat(post_url(entry, site), F.lit("?comment="), comment.cast("string"))


def media_url(key: Column, cdn: str, kind: Column | None = None) -> Column:
    """Where a media file is fetched: keys that are addresses are their own; of videos the form that plays."""
    made = F.concat(F.lit(f"{cdn.rstrip('/')}/"), key, F.lit("/"))
    return F.when(key.startswith("http"), key).when(kind == "video", F.concat(made, F.lit("-/format/mp4/"))).otherwise(made) if kind is not None else F.when(key.startswith("http"), key).otherwise(made)

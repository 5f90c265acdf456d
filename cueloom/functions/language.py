"""Names of languages and remapped error codes as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a primary language subtag is called.
NAMES = {
    "en": "English",
    "zh": "Chinese",
    "yue": "Cantonese",
    "de": "German",
    "fr": "French",
    "es": "Spanish",
    "pt": "Portuguese",
    "it": "Italian",
    "nl": "Dutch",
    "ru": "Russian",
    "ja": "Japanese",
    "ko": "Korean",
    "ar": "Arabic",
    "hi": "Hindi",
    "tr": "Turkish",
    "vi": "Vietnamese",
    "th": "Thai",
    "id": "Indonesian",
    "pl": "Polish",
    "uk": "Ukrainian",
    "sv": "Swedish",
}
#: Codes of collectors and file systems as the domain names them.
REMAPPED = {
    "collect/source-not-found": "source-unreadable",
    "fs/check-failed": "source-unreadable",
    "collect/probe-failed": "probe-failed",
    "collect/probe-timeout": "probe-failed",
    "collect/extract-failed": "audio-extract-failed",
}


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    out = F.when(key.isNull(), F.lit(None).cast("string"))
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def primary_subtag(tag: Column) -> Column:
    return F.lower(F.split(F.trim(tag), "-")[0])


def language_name(tag: Column) -> Column:
    """The name of a tag's language; null, which leaves it to the model, for any other tag."""
    return _lookup(primary_subtag(tag), NAMES, F.lit(None).cast("string"))


def remap_error(code: Column) -> Column:
    """A collector's code as the domain names it; others pass through."""
    return _lookup(code, REMAPPED, code)

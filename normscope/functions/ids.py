"""Ids from content, upload checks and listings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GROUPS, MIME_TYPES, MOST_BYTES


def content_id(pixels: Column) -> Column:
    """Id of what the model sees: equal pixels after resizing have equal ids."""
    return F.concat(F.lit("resized224-"), F.substring(F.sha2(pixels.cast("binary"), 256), 1, 32))


def sample_id(group: Column, raw: Column) -> Column:
    return F.concat(F.substring(group, 1, 1), F.lit("-"), F.substring(F.sha2(raw.cast("binary"), 256), 1, 16))


def filename_or_default(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("upload"))


def image_format(content: Column) -> Column:
    """PNG or JPEG by leading bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "PNG").when(F.substring(head, 1, 6) == "FFD8FF", "JPEG")


def upload_status(group: Column, mime: Column, size: Column, decodable: Column) -> Column:
    """What an upload is answered with: 404 group, 415 type, 413 size, 400 content, else 200; checked in this order."""
    return (
        F.when(~F.coalesce(group.isin(*GROUPS), F.lit(False)), 404)
        .when(~F.coalesce(F.lower(mime).isin(*MIME_TYPES), F.lit(False)), 415)
        .when(size > MOST_BYTES, 413)
        .when(~F.coalesce(decodable, F.lit(False)), 400)
        .otherwise(200)
    )

"""Schemas of the tables, and the constants that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Results must match them.
GROUPS = ("reference", "calibration")
FORMATS = ("PNG", "JPEG")
MIME_TYPES = ("image/png", "image/jpeg", "image/jpg")
MOST_BYTES = 10 * 1024 * 1024
INPUT_SIZE = 224
GRID = 28
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
BANK_SIZE = 256
QUANTILE = 0.95

#: How images are prepared; stored with each detector, told in its status.
PREPROCESS = {
    "input_size": [INPUT_SIZE, INPUT_SIZE],
    "resize": "bilinear whole-image resize (no center crop)",
    "color_space": "RGB",
    "normalization": "ImageNet per-channel mean/std",
    "mean": list(CHANNEL_MEAN),
    "std": list(CHANNEL_STD),
    "accepted_formats": list(FORMATS),
    "max_upload_bytes": MOST_BYTES,
}

SAMPLE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content_id", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("group", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
#: Row order of descriptors is (seq, cell).
DESCRIPTOR = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("descriptor", T.ArrayType(T.FloatType())),
    ]
)
#: A sample's image as it is stored, in its own size.
IMAGE = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("png", T.BinaryType())])
BANK = T.StructType([T.StructField("bank_pos", T.IntegerType()), T.StructField("descriptor", T.ArrayType(T.DoubleType()))])
#: Calibration scores in upload order.
SCORE = T.StructType([T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType())])
VERSION = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("memory_bank_items", T.LongType()),
        T.StructField("built_at", T.TimestampType()),
        T.StructField("preprocess", T.StringType()),
        T.StructField("samples_digest", T.LongType()),
    ]
)

PREPROCESSING = T.StructType(
    [
        T.StructField("input_size", T.ArrayType(T.IntegerType())),
        T.StructField("resize", T.StringType()),
        T.StructField("color_space", T.StringType()),
        T.StructField("normalization", T.StringType()),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("std", T.ArrayType(T.DoubleType())),
        T.StructField("accepted_formats", T.ArrayType(T.StringType())),
        T.StructField("max_upload_bytes", T.LongType()),
    ]
)
#: The state document: the whole catalogue and the detector's numbers in one row.
STATE = T.StructType(
    [
        T.StructField("samples", T.ArrayType(T.StructType([f for f in SAMPLE.fields if f.name != "seq"]))),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("calibration_scores", T.ArrayType(T.DoubleType())),
        T.StructField("built_at", T.StringType()),
        T.StructField("preprocess", PREPROCESSING),
    ]
)

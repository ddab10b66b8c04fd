"""The built-in caption presets as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, description, and the caption style in the order of FIELDS (None: not set).
FIELDS = [
    "fontFamily", "fontSize", "fontWeight", "color", "highlightColor", "position", "allCaps", "shadow", "wordsPerGroup", "punctuation",
]
PRESETS = [
    ("tiktok", "Bold centered captions for TikTok/Reels — yellow highlight, 3 words", ("Arial", 5.5, "bold", "#FFFFFF", "#FFD700", 70.0, True, True, 3, True)),
    ("subtitle", "Professional subtitle style — bottom-aligned, 6 words per group", ("Helvetica", 4.5, "medium", "#FFFFFF", None, 90.0, False, True, 6, True)),
    ("minimal", "Understated minimal captions — light font, no shadow", ("Helvetica", 4.0, "light", "#FFFFFF", None, 85.0, False, False, 4, True)),
    ("bold_center", "Bold centered captions — green highlight, 2 words per group", ("Arial", 7.0, "bold", "#FFFFFF", "#00FF88", 50.0, True, True, 2, True)),
    ("william", "Poppins bold, cream/burnt orange karaoke — 3 words, no punctuation", ("Poppins", 5.5, "bold", "#FAF9F5", "#D97757", 70.0, True, True, 3, False)),
    ("social_karaoke_pink", "Pink-highlight karaoke variant of william — Poppins bold, hot pink active word", ("Poppins", 5.5, "bold", "#FAF9F5", "#FF3EA5", 70.0, True, True, 3, False)),
    ("social_karaoke_white", "Monochrome karaoke — white Poppins bold, no colored highlight", ("Poppins", 5.5, "bold", "#AAAAAA", "#FFFFFF", 70.0, True, True, 3, False)),
    ("interview_attribution", "Understated interview captions — bottom, Helvetica medium, 8 words", ("Helvetica", 4.0, "medium", "#FFFFFF", None, 90.0, False, True, 8, True)),
    ("podcast_big", "Oversized podcast captions — centered black Helvetica, yellow highlight, 2 words", ("Helvetica", 10.0, "black", "#FFFFFF", "#FFE135", 50.0, True, True, 2, False)),
    ("slideshow_serif", "Clean serif lower-third — Georgia regular, 7 words per group", ("Georgia", 4.5, "regular", "#FFFFFF", None, 88.0, False, True, 7, True)),
    ("screencast_clean", "Low-distraction screencast captions — Helvetica medium at 92% height, 8 words", ("Helvetica", 4.0, "medium", "#FFFFFF", None, 92.0, False, True, 8, True)),
]


def built_in_presets(spark: SparkSession) -> DataFrame:
    """name, type, description, config_json, created, updated."""
    rows = []
    for name, description, style in PRESETS:
        config = {field: value for field, value in sorted(zip(FIELDS, style)) if value is not None}
        rows.append((name, "caption", description, json.dumps(config, separators=(",", ":"))))
    now = F.current_timestamp()
    return spark.createDataFrame(rows, "name string, type string, description string, config_json string").withColumns({"created": now, "updated": now})

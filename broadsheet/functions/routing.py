"""Which pipeline a document's language goes to: P22, P23."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import text as T

# Languages in order of trial, with their codes and names; readers; languages whose page answers come from the other provider.
LANGUAGES = [
    ("english", ["en", "eng"], ["english"], "rapidocr"),
    ("hindi", ["hi", "hin"], ["hindi"], "tesseract"),
    ("gujarati", ["gu", "guj"], ["gujarati"], "tesseract"),
    ("marathi", ["mr", "mar"], ["marathi"], "rapidocr"),
    ("tamil", ["ta", "tam"], ["tamil"], "tesseract"),
    ("telugu", ["te", "tel"], ["telugu"], "tesseract"),
    ("kannada", ["kn", "kan"], ["kannada"], "tesseract"),
    ("malayalam", ["ml", "mal"], ["malayalam"], "tesseract"),
    ("punjabi", ["pa", "pan"], ["punjabi"], "tesseract"),
    ("bengali", ["bn", "ben"], ["bengali"], "tesseract"),
    ("assamese", ["as", "asm"], ["assamese"], "tesseract"),
    ("odia", ["or", "ori"], ["odia", "oriya"], "tesseract"),
    ("urdu", ["ur", "urd"], ["urdu"], "utrnet"),
]
FALLBACK = "hindi"


def pipeline_of(language: Column | str) -> Column:
    """The code of the first language that matches, hindi if none does."""
    lang = F.lower(T.strip(language))
    hits = [F.when(lang.isin(codes) | T.contains_any(lang, names), code) for code, codes, names, _ in LANGUAGES]
    return F.coalesce(*hits, F.lit(FALLBACK))


def provider(language: Column | str, local: bool = False) -> Column:
    """local overrides what the language says."""
    return F.lit("local") if local else F.when(pipeline_of(language) == "telugu", "gemini").otherwise("openai")


def dimension(spark: SparkSession) -> DataFrame:
    """code, priority, reader, right_to_left."""
    return spark.createDataFrame([(code, k, reader, code == "urdu") for k, (code, _, _, reader) in enumerate(LANGUAGES)], "code string, priority int, reader string, right_to_left boolean")

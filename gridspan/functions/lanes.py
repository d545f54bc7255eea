"""Lane labels: how they are written and the lane that each stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import roman

# Ways to write each education, the credits that lanes have, and the lanes that
# numbers stand for (LANE 1, PAY SCALE 1, LEVEL 1 or I, and so on).
WRITTEN = {
    "BA": ("B.A.", "BACCALAUREATE", "BACHELOR'S", "BACHELORS", "BACHELOR", "BA", "B"),
    "MA": ("M.A.", "MASTER'S", "MASTERS", "MASTER", "MA", "M"),
    "DOC": ("DOCTORATE", "DOCTORAL", "DOC", "EDD", "PHD", "DR"),
    "CAGS": ("CAGS",),
}
LANES = {"BA": ("B", 0), "MA": ("M", 0), "DOC": ("D", 0), "CAGS": ("M", 60)}
CREDITS = (0, 10, 15, 20, 30, 36, 40, 45, 60, 75, 90)
NUMBERED = (("B", 0), ("B", 15), ("B", 30), ("M", 0), ("M", 15), ("M", 30), ("M", 45), ("M", 60))
DEGREE_TEXT = {"B": "Bachelor's", "M": "Master's", "D": "Doctorate"}

# The grammar of a label, in capitals: an education, DEGREE or not, and credits behind a sign (in
# brackets or not, a 1 perhaps read as L or I) or right behind it. It reads alike in Java and Python.
EDUCATION = "|".join(f"({'|'.join(x.replace('.', '[.]') for x in names)})" for names in WRITTEN.values())
LABEL = rf"(?<![A-Z0-9])(?:{EDUCATION})(?:\s*DEGREE)?(?:\s*[-+:–—]\s*[(]?\s*([0-9LI][0-9]?)\s*[)]?|([0-9]{{1,2}}))?(?![A-Z0-9])"
SIGNED, BARE = len(WRITTEN) + 1, len(WRITTEN) + 2
#: A number that stands for a lane: with a word before it, or a roman one alone or in brackets behind a B or M.
NUMBER = r"^\s*(?:(?:LANE|PAY\s*SCALE|LEVEL)\s*([0-9]+|[IVX]+)|(?:B\.?A?\.?|M\.?A\.?)?\s*[(]([IVX]+)[)]|([IVX]+))\s*$"


def _education(label: Column) -> Column:
    """The name in WRITTEN of the education that a label begins with."""
    return F.coalesce(*[F.when(F.regexp_extract(label, LABEL, k + 1) != "", F.lit(name)) for k, name in enumerate(WRITTEN)])


def _credits(label: Column) -> Column:
    """The credits of a label as text, blank if it names none."""
    return F.translate(F.concat(F.regexp_extract(label, LABEL, SIGNED), F.regexp_extract(label, LABEL, BARE)), "LI", "11")


def lane_tokens(text: Column) -> Column:
    """The lane labels in a line, in order and one spelling: ``BA, BA+15, MA``."""
    found = F.regexp_extract_all(F.upper(text), F.lit(LABEL), F.lit(0))
    return F.transform(found, lambda x: F.concat_ws("+", _education(x), F.nullif(_credits(x), F.lit(""))))


def lane_key(label: Column) -> Column:
    """One spelling of a label: ``BA+15``, or ``LANE4`` for a number; null if it is neither."""
    number = _number(label)
    return F.when(number.isNotNull(), F.concat(F.lit("LANE"), number.cast("string"))).otherwise(F.get(lane_tokens(label), F.lit(0)))


def _number(label: Column) -> Column:
    upper = F.upper(label)
    text = F.coalesce(*[F.nullif(F.regexp_extract(upper, NUMBER, k), F.lit("")) for k in (1, 2, 3)])
    return F.get(F.transform(F.array(text), lambda t: F.coalesce(t.try_cast("int"), roman(t))), F.lit(0))


def normalize_education(label: Column) -> Column:
    """A label in capitals with one spelling of its education; others only lose their blanks."""
    return F.coalesce(F.get(lane_tokens(label), F.lit(0)), F.replace(F.upper(F.trim(label)), F.lit(" "), F.lit("")), F.lit(""))


def _lane(education: str, credits: int) -> Column:
    return F.struct(F.lit(education).alias("education"), F.lit(credits).cast("int").alias("credits"))


def lane_of(label: Column) -> Column:
    """struct(education, credits) of one label, or null."""
    # through arrays of one element, for what is used several times would be worked out each time
    first = F.get(F.regexp_extract_all(F.upper(label), F.lit(LABEL), F.lit(0)), F.lit(0))
    parts = F.array(F.struct(first.alias("first"), _credits(F.upper(label)).try_cast("int").alias("credits"), _number(label).alias("number")))
    read = F.transform(parts, lambda x: F.struct(_education(x["first"]).alias("name"), x["credits"].alias("credits"), x["number"].alias("number")))

    def lane(x: Column) -> Column:
        named = F.lit(None)
        for known, (education, own) in LANES.items():
            named = F.when(x["name"] == known, F.struct(F.lit(education).alias("education"), F.coalesce(x["credits"], F.lit(own)).cast("int").alias("credits"))).otherwise(named)
        return F.coalesce(F.when(x["number"].isNotNull(), F.get(F.array(*[_lane(*y) for y in NUMBERED]), x["number"] - 1)), F.when(x["number"].isNull(), named))

    return F.get(F.transform(read, lane), F.lit(0))


def lane_text(education: Column, credits: Column) -> Column:
    """``Master's +30`` for people to read; an unknown education stays as it is."""
    name = education
    for letter, text in DEGREE_TEXT.items():
        name = F.when(education == letter, text).otherwise(name)
    return F.when(credits > 0, F.concat(name, F.lit(" +"), credits.cast("string"))).otherwise(name)


def lane_table(spark: SparkSession) -> DataFrame:
    """Label to lane: every spelling of an education with every number of credits, and the numbered lanes."""
    rows = []
    for name, (letter, own) in LANES.items():
        for text in WRITTEN[name]:
            rows.append((text, letter, own))
            if letter != "D" and name != "CAGS":
                rows += [(f"{text}{sign}{c}", letter, c) for c in CREDITS for sign in ("+", "") if "." not in text]
    rows += [(f"{word}{k + 1}", *lane) for word in ("LANE", "PAYSCALE", "LEVEL") for k, lane in enumerate(NUMBERED)]
    return spark.createDataFrame(rows, "label string, education string, credits int").distinct()

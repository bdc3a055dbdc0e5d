"""Functions over names, descriptions, headers and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The words that name a contrast pass, and the numbered-phase prefix.
PASS_WORDS = {"1st": 1, "2nd": 2, "3rd": 3, "4th": 4}
PHASE_PREFIX = r"\bph\s*(\d)\b"
BASELINE_WORDS = ("pre", "dyn")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_text(c: Column | str, needle: str) -> Column:
    """Case-insensitive substring test; a null text counts as empty."""
    return F.lower(F.coalesce(_c(c), F.lit(""))).contains(needle.lower())


def phase_rank(c: Column | str) -> Column:
    """Contrast phase of a series description: 0 before contrast, 1.. after, else null.

    A numbered prefix wins over pass words, which win over the two baseline words.
    """
    d = F.lower(F.coalesce(_c(c), F.lit("")))
    digit = F.regexp_extract(d, PHASE_PREFIX, 1)
    out = F.when(digit != "", digit.cast("int"))
    for word, rank in PASS_WORDS.items():
        out = out.when(d.contains(word), rank)
    for word in BASELINE_WORDS:
        out = out.when(d.contains(word), 0)
    return out


def view_key(image_laterality: Column | str, laterality: Column | str,
             frame_laterality: Column | str, view_position: Column | str) -> Column:
    """Side plus view in lower case; the first non-empty side attribute is used."""
    def filled(c):
        return F.nullif(_c(c), F.lit(""))
    side = F.coalesce(filled(image_laterality), filled(laterality), filled(frame_laterality), F.lit(""))
    return F.lower(F.concat(side, F.coalesce(_c(view_position), F.lit(""))))


def nested_frame_laterality(sequence: Column | str) -> Column:
    """First frame side inside ``array<struct<FrameAnatomySequence: array<struct<FrameLaterality>>>>``."""
    first = F.try_element_at(_c(sequence), F.lit(1))
    anatomy = F.try_element_at(first.getField("FrameAnatomySequence"), F.lit(1))
    return anatomy.getField("FrameLaterality")


def file_stem(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def case_key(case_id: Column | str, path: Column | str) -> Column:
    """Stored case id when there is one, else the file stem."""
    return F.coalesce(F.nullif(_c(case_id), F.lit("")), file_stem(path))


def parse_histology_name(name: Column | str) -> Column:
    """``SOB_B_TA-14-4659-100-001.png`` as a struct; null when a part is missing.

    Parts: ``procedure_class_type - patient - image - magnification - number``; class ``B``
    is benign.
    """
    stem = F.regexp_replace(_c(name), r"\.[^.]*$", "")
    dash = F.split(stem, "-")
    head = F.split(F.get(dash, F.lit(0)), "_")
    ok = (F.size(dash) >= 5) & (F.size(head) >= 3)
    return F.when(ok, F.struct(
        F.get(head, F.lit(2)).alias("tumor_type"),
        F.get(dash, F.lit(1)).alias("patient_id"),
        F.get(dash, F.lit(2)).alias("image_id"),
        F.get(dash, F.lit(3)).alias("magnification"),
        F.get(dash, F.lit(4)).alias("image_number"),
        (F.get(head, F.lit(1)) == "B").alias("is_benign"),
    ))


def scrub_path(c: Column | str, root: str) -> Column:
    """Absolute paths below ``root`` become root-relative with forward slashes."""
    text = F.regexp_replace(_c(c), r"\\", "/")
    root = root.replace("\\", "/").rstrip("/")
    inside = (text == root) | text.startswith(root + "/")
    rel = F.regexp_replace(text, "^" + re.escape(root) + "/*", "")
    return F.when(inside, F.when(rel == "", ".").otherwise(rel)).otherwise(_c(c))

"""Paths, class names and label tokens as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Last extension in lower case with its dot, or the empty string."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1))


def first_number(text: Column) -> Column:
    """First run of digits as a number, null without one."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")


def timestamp_prefix(name: Column) -> Column:
    return F.substring_index(name, "_", 2)


def output_name(source: Column, name: Column, ending: Column) -> Column:
    return F.concat(source, F.lit("_"), name, ending)


def tidy(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def class_number(token: Column) -> Column:
    """Class index that may be written as a float; null if it can't be read."""
    return token.try_cast("double").cast("int")


def label_tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def polygon(tokens: Column) -> Column:
    """Points of a segmentation label after its class token."""
    n = ((F.size(tokens) - 1) / 2).cast("int")
    point = lambda i: F.struct(F.get(tokens, 2 * i + 1).try_cast("double").alias("x"), F.get(tokens, 2 * i + 2).try_cast("double").alias("y"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), point))

"""Severity vocabularies of the sources, folded onto one scale."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logbraid.functions.identifiers import extract_level

# Severity names per source.
MYSQL_LEVELS = {"SYSTEM": "INFO", "NOTE": "DEBUG", "WARNING": "WARN", "ERROR": "ERROR"}
POSTGRES_LEVELS = {
    "DEBUG1": "DEBUG",
    "DEBUG2": "DEBUG",
    "DEBUG3": "DEBUG",
    "DEBUG4": "DEBUG",
    "DEBUG5": "DEBUG",
    "LOG": "INFO",
    "INFO": "INFO",
    "NOTICE": "INFO",
    "WARNING": "WARN",
    "ERROR": "ERROR",
    "FATAL": "FATAL",
    "PANIC": "FATAL",
}


def lookup(table: dict, key: Column) -> Column:
    """Value of a small constant table, null where the key is missing."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), F.coalesce(key, F.lit("")))


def known_mysql_level(priority: Column) -> Column:
    return lookup(MYSQL_LEVELS, F.upper(priority))


def known_postgres_level(severity: Column) -> Column:
    return lookup(POSTGRES_LEVELS, F.upper(severity))


def known_gcp_level(severity: Column) -> Column:
    return F.nullif(severity, F.lit(""))


def fold_mysql_level(priority: Column, message: Column) -> Column:
    return F.coalesce(known_mysql_level(priority), extract_level(message))


def fold_postgres_level(severity: Column, message: Column) -> Column:
    return F.coalesce(known_postgres_level(severity), extract_level(message))


def gcp_level(severity: Column, message: Column) -> Column:
    return F.coalesce(known_gcp_level(severity), extract_level(message))

"""Readers of exported logs, log files and database log tables."""
from logbraid.sources.databases import mysql_records, oracle_records, read_mysql, read_oracle
from logbraid.sources.exports import cloudwatch_records, gcp_records, read_cloudwatch, read_gcp, unreadable_lines
from logbraid.sources.logfiles import read_log_lines, read_postgres_log, read_tomcat
from logbraid.sources.scenarios import read_scenarios
from logbraid.sources.stitch import stitch_postgres, stitch_tomcat
from logbraid.sources.union import parse_database_entries, union_sources, union_with_failures

__all__ = [
    "cloudwatch_records",
    "gcp_records",
    "mysql_records",
    "oracle_records",
    "parse_database_entries",
    "read_cloudwatch",
    "read_gcp",
    "read_log_lines",
    "read_mysql",
    "read_oracle",
    "read_postgres_log",
    "read_scenarios",
    "read_tomcat",
    "stitch_postgres",
    "stitch_tomcat",
    "union_sources",
    "union_with_failures",
    "unreadable_lines",
]

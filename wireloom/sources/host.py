"""Tables of a host, parsed from what its tools print: sockets, programs, places, settings."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bytes import ipv4_bytes, let
from ..operators.correlate import ipv6_bytes
from . import mmdb

# Protocol numbers by the tools' words.
PROTOCOLS = {"TCP": 6, "UDP": 17}


def _protocol(word: Column) -> Column:
    return F.when(word == "TCP", 6).when(word == "UDP", 17)


def endpoint(text: Column, zones: bool = False) -> tuple[Column, Column]:
    """Address bytes and port of ``1.2.3.4:80`` or ``[v6]:80``; nulls for ``*`` and what isn't one.

    ``zones`` drops a zone id from a version 6 address.
    """

    def six(inner: Column) -> Column:
        return F.when((inner != "") & inner.rlike(r"^[0-9A-Fa-f:.]+$") & inner.contains(":"), ipv6_bytes(inner))

    v6 = F.regexp_extract(text, r"^\[(.+?)\]:([0-9]+)$", 1)
    v4 = F.regexp_extract(text, r"^([0-9.]+):([0-9]+)$", 1)
    ip = F.coalesce(let(F.regexp_replace(v6, "%.*$", "") if zones else v6, six), let(v4, ipv4_bytes))
    port = F.regexp_extract(text, r":([0-9]{1,5})$", 1).try_cast("int")
    # both ends of the address are worked out once, and are there only together
    both = let(F.struct(ip.alias("ip"), port.alias("port")), lambda x: F.when(x["ip"].isNotNull() & (x["port"] <= 65535), x))
    return both["ip"], both["port"]


def proc_net(lines: DataFrame) -> DataFrame:
    """(protocol, addr, port, inode) of the lines of ``/proc/net/{tcp,tcp6,udp,udp6}``.

    ``lines`` are (file, line_no, value); the first line of a file is its header.
    Addresses are hex words in host order: every four bytes are turned round.
    """
    part = F.split(F.trim(F.col("value")), r"\s+")
    local = F.split(F.get(part, F.lit(1)), ":")
    addr, port = F.get(local, F.lit(0)), F.get(local, F.lit(1))
    turned = F.regexp_replace(addr, r"(..)(..)(..)(..)", "$4$3$2$1")
    good = (F.size(part) >= 10) & (F.size(local) == 2) & addr.rlike("^([0-9A-Fa-f]{8}|[0-9A-Fa-f]{32})$") & port.rlike("^[0-9A-Fa-f]{1,4}$") & F.get(part, F.lit(9)).rlike("^[0-9]+$")
    rows = lines.filter("line_no > 0").filter(good)
    out = rows.select(F.when(F.col("file").contains("udp"), 17).otherwise(6).alias("protocol"), F.unhex(turned).alias("addr"), F.conv(port, 16, 10).cast("int").alias("port"), F.get(part, F.lit(9)).cast("long").alias("inode"))
    return out.filter("inode <> 0")


def with_programs(sockets: DataFrame, links: DataFrame) -> DataFrame:
    """Sockets with the program that holds them: ``links`` are (inode, pid, name, exe_path)."""
    return sockets.join(links, "inode", "left").drop("inode")


def lsof(lines: DataFrame) -> DataFrame:
    """(protocol, addr, port, pid, name) of tagged ``lsof -F`` lines (K11); ``lines`` are (snapshot, line_no, value).

    A process line sets the pid and forgets the rest, ``c`` the command, ``f``
    a new file, ``P`` its protocol; ``n`` is a socket if the protocol is known.
    The state is what the last line of its kind said: running lasts within
    the last process and the last file.
    """
    tag, rest = F.substring("value", 1, 1), F.expr("substring(value, 2)")
    w = Window.partitionBy("snapshot").orderBy("line_no")
    rows = lines.withColumn("_t", tag).withColumn("_v", rest)
    rows = rows.withColumn("_p", F.sum(F.when(F.col("_t") == "p", 1).otherwise(0)).over(w))
    rows = rows.withColumn("_f", F.sum(F.when(F.col("_t").isin("p", "f"), 1).otherwise(0)).over(w))
    by_process = Window.partitionBy("snapshot", "_p").orderBy("line_no")
    by_file = Window.partitionBy("snapshot", "_p", "_f").orderBy("line_no")
    last = lambda t, c, over: F.last(F.when(F.col("_t") == t, c), ignorenulls=True).over(over)
    rows = rows.withColumn("pid", F.coalesce(last("p", F.col("_v"), by_process).try_cast("long"), F.lit(0)))
    rows = rows.withColumn("name", F.coalesce(last("c", F.col("_v"), by_process), F.lit("")))
    rows = rows.withColumn("protocol", _protocol(last("P", F.col("_v"), by_file)))
    local = F.get(F.split("_v", "->"), F.lit(0))
    ip, port = endpoint(local)
    return rows.filter("_t = 'n' and protocol is not null").select("protocol", ip.alias("addr"), port.alias("port"), "pid", "name").filter("addr is not null")


def netstat(lines: DataFrame) -> DataFrame:
    """(protocol, addr, port, pid) of ``netstat -ano`` lines."""
    part = F.split(F.trim(F.col("value")), r"\s+")
    ip, port = endpoint(F.get(part, F.lit(1)), zones=True)
    pid = F.element_at(part, -1).try_cast("long")
    rows = lines.filter(F.size(part) >= 4)
    return rows.select(_protocol(F.get(part, F.lit(0))).alias("protocol"), ip.alias("addr"), port.alias("port"), pid.alias("pid")).filter("protocol is not null and pid is not null and addr is not null")


def tasklist(lines: DataFrame) -> DataFrame:
    """(pid, name) of ``tasklist /NH /FO CSV`` lines."""
    part = F.split("value", '","')
    pid = F.regexp_replace(F.get(part, F.lit(1)), '^"+|"+$', "").try_cast("long")
    return lines.filter(F.size(part) >= 2).select(pid.alias("pid"), F.regexp_replace(F.get(part, F.lit(0)), '^"+', "").alias("name")).filter("pid is not null")


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, value, status) of programs by the SHA-256 of their files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.lit("Sha256").alias("kind"), F.sha2("content", 256).alias("value"), F.lit("Unsigned").alias("status"))


def codesign(lines: DataFrame) -> DataFrame:
    """Identities of programs from signature lines (K13); ``lines`` are (path, line_no, value, success).

    The last identifier, team and hash count, and the first authority; a team
    that is ``not set`` is none; the word ``adhoc`` anywhere makes the status AdHoc.
    """
    after = lambda tag: F.when(F.col("value").startswith(tag), F.trim(F.expr(f"substring(value, {len(tag) + 1})")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    team = after("TeamIdentifier=")
    status = F.when(F.bool_or(F.col("value").contains("adhoc")), "AdHoc").when(F.bool_or("success"), "Valid").otherwise("Unsigned")
    authority = after("Authority=")
    return lines.groupBy("path").agg(
        F.lit("MacCodesign").alias("kind"), F.coalesce(last(after("CDHash=")), F.lit("")).alias("value"), last(after("Identifier=")).alias("signing_id"), last(F.when(team != "not set", team)).alias("team_id"),
        F.min_by(authority, F.when(authority.isNotNull(), F.col("line_no"))).alias("authority"), status.alias("status"),
    )


def ranges(spark: SparkSession, path: str | None, columns: str) -> DataFrame | None:
    """Address ranges from a Parquet table, a CSV file of (start, end, ...) texts or a MaxMind DB file; None if it isn't there (K9).

    ``columns`` is the schema of what follows the two ends, e.g. ``country string``.  A
    ``.mmdb`` file that is broken counts as not there.
    """
    if path is None:
        return None
    if path.endswith(".mmdb"):
        return mmdb.networks(spark, path, columns)
    try:
        rows = spark.read.schema(f"start_ip string, end_ip string, {columns}").csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    kinds = dict(rows.dtypes)
    for c in ("start_ip", "end_ip"):
        if kinds[c] == "string":
            rows = rows.withColumn(c, F.when(F.col(c).contains(":"), ipv6_bytes(F.col(c))).otherwise(ipv4_bytes(F.col(c))))
    return rows


@dataclass(frozen=True)
class Settings:
    """A settings file."""

    default_interface: str | None = None
    color_scheme: str = "default"
    filters: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """From TOML; a file that isn't there gives the defaults, a broken one too, with a warning."""
        path = Path(path)
        if not path.exists():
            return cls()
        try:
            got = tomllib.loads(path.read_text())
            out = cls(got.get("default_interface"), got.get("color_scheme", "default"), dict(got.get("filters", {})))
            if not all(isinstance(v, str) for v in out.filters.values()):
                raise TypeError("filters are texts")
        except (tomllib.TOMLDecodeError, TypeError, ValueError) as e:
            warnings.warn(f"{path}: {e}; using the defaults", stacklevel=2)
            return cls()
        return out

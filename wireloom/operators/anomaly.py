"""Cheap signs of trouble in single packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import payload_bytes

# Ports on which cleartext HTTP is nothing unusual.
HTTP_PORTS = (80, 8080, 8000, 8888, 3000)


def annotated(packets: DataFrame) -> DataFrame:
    """``packets`` with ``anomaly`` (kind, detail, severity), null for most.

    Anything encrypted has none.  Then, in this order: basic credentials in an
    HTTP header, HTTP on an unusual port (both ports are), an FTP password.
    """
    sp, dp = F.coalesce("tcp.src_port", "udp.src_port"), F.coalesce("tcp.dst_port", "udp.dst_port")
    sealed = F.col("tls_client_hello").isNotNull() | F.col("tls_handshake").isNotNull() | F.col("quic").isNotNull()
    http = F.col("http").isNotNull()
    basic = F.exists("http.headers", lambda h: (F.lower(h["name"]) == "authorization") & F.lower(h["value"]).startswith("basic"))
    odd = http & ~sp.isin(*HTTP_PORTS) & ~dp.isin(*HTTP_PORTS)
    raw = F.upper(F.decode(payload_bytes(), "ISO-8859-1"))
    ftp = ((sp == 21) | (dp == 21)) & raw.contains("PASS ")
    note = lambda kind, detail, severity: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), F.lit(severity).alias("severity"))
    found = (
        F.when(sealed, None)
        .when(http & basic, note("PlaintextCredential", F.lit("HTTP Basic credentials sent in cleartext"), "Warning"))
        .when(odd, note("UnusualPort", F.concat(F.lit("cleartext HTTP on unusual port "), dp.cast("string")), "Info"))
        .when(ftp, note("PlaintextCredential", F.lit("FTP password sent in cleartext"), "Warning"))
    )
    return packets.withColumn("anomaly", found)

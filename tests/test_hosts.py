"""Users beyond 65,535 keep addresses of their own.

The SQL writes user u as 10.0.(u // 256).(u % 256).  From 65,536 on that is no address (10.0.256.0), so
no frame holds it: there the queries are compared with the same SQL, u // 256 spelled as two octets.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from wireloom.plans import views

from .conftest import SF
from .test_registry import ordered

# by the third octet cut to two hex digits, 65,536 was 4,096 and 70,000 was 4,464
USERS = [0, 255, 256, 4096, 4464, 65535, 65536, 70000, 89999, 899999, (1 << 24) - 1]
SHORT = "'10.0.' || (u // 256) || '.' || (u % 256)"
WHOLE = "'10.' || (u // 65536) || '.' || (u // 256 % 256) || '.' || (u % 256)"
NAMES = ["top_talkers", "top_talkers_filtered", "decode_arp", "decode_ipv4", "flow_table", "timeline", "packet_summary", "monitor_events", "capture_pcap", "capture_pcapng", "capture_filtered", "capture_stream", "json_fields"]


def events(folder, users, n=330):
    c = duckdb.connect()
    kinds = "['click', 'purchase', 'error', 'view', 'signup']"
    c.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 7 SECOND AS ts, CAST({users}[i % {len(users)} + 1] AS BIGINT) AS user_id, {kinds}[i // {len(users)} % 5 + 1] AS event_type,
        CAST(i * 37 % 500 AS DOUBLE) AS value, '{{"k": ' || (i * 13 % 100) || '}}' AS props FROM range({n}) AS r(i)) TO '{folder}/events.parquet'""")
    c.execute(f"COPY (FROM '{SF}/nation.parquet') TO '{folder}/nation.parquet'")
    for name in ("events", "nation"):
        c.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return c


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    return str(folder), events(folder, USERS)


@pytest.mark.parametrize("name", NAMES)
def test_users_beyond_two_octets(spark, many, name):
    folder, duck = many
    sql = entry.oracle_sql()[name]
    assert SHORT in sql
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql.replace(SHORT, WHOLE)})")
    assert ordered(df.select(*columns).collect()) == ordered(want.fetchall())


def test_a_user_without_an_address_is_refused(spark, tmp_path):
    events(tmp_path, [1, 1 << 24], 4)
    with pytest.raises(Exception, match="user_id 16777216 has no address"):
        views.frames(spark, str(tmp_path)).select("data").collect()

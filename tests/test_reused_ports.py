"""Tables in which orders share their ends and times: results must still be those of the SQL."""

import duckdb
import pandas as pd
import pytest

from packetloom import catalog
from tests.test_queries import SF, rows

#: Orders this far apart have the same ports and server.
_SAME_ENDS = 180_000


@pytest.fixture(scope="module")
def reused(tmp_path_factory):
    """Each tenth order again under two other keys: as it was, and a day later with other sequence numbers."""
    at, con = tmp_path_factory.mktemp("reused"), duckdb.connect()
    con.execute(f"CREATE VIEW l AS SELECT * FROM '{SF}/lineitem.parquet'")
    con.execute(f"CREATE VIEW o AS SELECT * FROM '{SF}/orders.parquet'")
    again = "SELECT * REPLACE (l_orderkey + {n} AS l_orderkey, l_shipdate + INTERVAL {days} DAY AS l_shipdate, l_extendedprice + {days} AS l_extendedprice) FROM l WHERE l_orderkey % 10 = 3"
    con.execute(f"COPY (SELECT * FROM l UNION ALL {again.format(n=_SAME_ENDS, days=0)} UNION ALL {again.format(n=2 * _SAME_ENDS, days=1)}) TO '{at}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (o_orderkey + k * {_SAME_ENDS} AS o_orderkey) FROM o, range(3) r(k)) TO '{at}/orders.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["capture_file_connections", "connections_five_tuple", "dns_service_times"])
def test_reused_ends_agree_with_sql(spark, reused, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{reused}/{table}.parquet'")
    got = catalog.queries()[name](spark, reused).toPandas()
    answer = con.execute(catalog.oracle_sql()[name])
    want = pd.DataFrame(answer.fetchall(), columns=[c[0] for c in answer.description])
    assert rows(got) == rows(want)

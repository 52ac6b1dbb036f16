import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE = datetime(2025, 1, 1)


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=4, app="tidewater-tests")
    yield s


@pytest.fixture
def ports(spark):
    """Two ports (New York, Los Angeles) as (portName, lat_dd, lon_dd)."""
    return spark.createDataFrame(
        [(1, "NewYorkPort", 40.7, -74.0), (2, "LosAngelesPort", 33.7, -118.2)],
        "port_number int, portName string, lat_dd double, lon_dd double")


PING_SCHEMA = "ping_id long, mmsi long, base_date_time timestamp_ntz, latitude double, longitude double, sog double"


def hourly(mmsi, lon, lat, sog, n_hours=3, start=0, first_id=0):
    return [(first_id + i, mmsi, BASE + timedelta(hours=start + i), lat, lon, sog) for i in range(n_hours)]


def make_pings(spark, rows):
    return spark.createDataFrame(rows, PING_SCHEMA)


def at(h):
    return BASE + timedelta(hours=h)

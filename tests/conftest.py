import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", shuffle_partitions=4, driver_memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PANEL = ("city_id bigint, store_id bigint, management_group_id bigint, first_category_id bigint, second_category_id bigint, "
         "third_category_id bigint, product_id bigint, series_id string, date date, observed_demand double, "
         "stockout_hours double, discount double, holiday_flag int, activity_flag int, precpt double, "
         "avg_temperature double, avg_humidity double, avg_wind_level double")


def demand(k, i):
    import math
    return max(10 + k + 2 * math.sin(2 * math.pi * i / 7) + 0.5 * (i % 5), 0.1)


@pytest.fixture(scope="session")
def panel(spark):
    """Three series of 70 days with closed-form demand."""
    rows = []
    for k in (1, 2, 3):
        for i in range(70):
            d = date(2025, 1, 1) + timedelta(days=i)
            rows.append((1, k, 1, 1, 1, k, 100 + k, f"{k}_{100 + k}", d, demand(k, i), float(i % 3), 1 - 0.05 * (i % 2),
                         int(d.weekday() == 6), int(i % 10 == 0), float(i % 4), 15.0 + k, 50.0 + i % 10, 3.0 + i % 3))
    return spark.createDataFrame(rows, PANEL)


def raw_of(panel):
    return panel.drop("series_id").withColumnsRenamed(
        {"date": "dt", "observed_demand": "sale_amount", "stockout_hours": "stock_hour6_22_cnt"})

import datetime as dt

from shelfwise.schema import CATALOGUE_DDL, PRODUCT_COLUMNS, STATE_COLUMNS


def product(site="a", product_id="1", **values):
    """A product with defaults as stored."""
    out = {}
    for c, kind in PRODUCT_COLUMNS.items():
        out[c] = "" if kind == "string" else [] if kind.startswith("array") else {} if kind.startswith("map") else None
    out |= {"site": site, "product_id": product_id, "brand": "Minimalist", "scraped_at": dt.datetime(2026, 8, 11)} | values
    return out


def products(spark, rows, extra=""):
    ddl = ", ".join(f"{c} {k}" for c, k in PRODUCT_COLUMNS.items()) + extra
    names = [x.split()[0] for x in ddl.replace("map<string,string>", "map").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def stored(spark, rows):
    names = [*PRODUCT_COLUMNS, *STATE_COLUMNS]
    return spark.createDataFrame([tuple(({"is_active": True, "missing_run_count": 0} | r).get(n) for n in names) for r in rows], CATALOGUE_DDL)

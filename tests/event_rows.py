"""Literal event rows for the tests."""

import datetime as dt

EV_SCHEMA = ("actor_id long, subject_id long, event_date date, month string, product string, "
             "product_group string, quantity double, use_flag string, source string, institution string, "
             "birth_year int, birth_year_alt int")


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def make_events(spark, rows):
    """rows: (actor, subject, 'yyyy-mm-dd', product[, use_flag[, quantity[, birth_year, birth_year_alt]]])."""
    out = []
    for r in rows:
        a, s, day, p = r[:4]
        use = r[4] if len(r) > 4 else "0"
        q = r[5] if len(r) > 5 else 1.0
        by = r[6] if len(r) > 6 else 1980
        by2 = r[7] if len(r) > 7 else by
        date = d(day)
        out.append((a, s, date, date.strftime("%Y-%m"), p, "G", float(q), use, "F", None, by, by2))
    return spark.createDataFrame(out, EV_SCHEMA)

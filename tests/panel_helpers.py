import datetime


def day(n: int) -> datetime.date:
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]

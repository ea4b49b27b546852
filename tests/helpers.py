import datetime as dt

from tools.check import canon


def rows_of(df):
    return canon(df.columns, [tuple(r) for r in df.collect()])


def same(a, b):
    assert rows_of(a) == rows_of(b)


def at(text):
    return dt.datetime.fromisoformat(text)

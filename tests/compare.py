"""Order-free comparison of a Spark result with a DuckDB result."""

import math


def shown(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return repr(v)


def same_rows(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    places = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(shown(r[i]) for i in places) for r in relation.fetchall())
    assert ours == theirs

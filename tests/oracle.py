"""Comparison of a DataFrame with a DuckDB relation."""


def canonical(value):
    """Values as the two engines can share them: floats by six digits, lists as tuples."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        return f"{float(value) + 0.0:.6g}"
    if isinstance(value, int):
        return f"{value}" if abs(value) >= 10**6 else f"{value:.6g}"
    if isinstance(value, list):
        return tuple(map(canonical, value))
    return str(value)


def same_rows(frame, relation):
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    mine = sorted(repr([canonical(r[c]) for c in columns]) for r in frame.collect())
    other = sorted(repr([canonical(r[i]) for i in at]) for r in relation.fetchall())
    assert mine == other

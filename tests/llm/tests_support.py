"""Shared helpers."""


def plain_rows(rows):
    return sorted(tuple("null" if v is None else str(v) for v in r) for r in rows)

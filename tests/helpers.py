import contextlib
import io
import math


def shown(value):
    """NaN as text, since NaN is not equal to itself."""
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def rows(df):
    found = [tuple(shown(v) for v in row) for row in df.collect()]
    return sorted(found, key=lambda row: [(v is not None, str(v)) for v in row])


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()

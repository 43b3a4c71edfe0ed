"""Results as plain rows."""


def local_rows(df):
    return [r.asDict() for r in df.collect()]

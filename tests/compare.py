"""Compare a DataFrame with a SQL result, order aside."""


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if x != x else repr(round(x, 6) + 0.0)
        return str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == want

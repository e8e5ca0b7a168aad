"""What tests share that is no fixture. (A conftest can't be imported by name: there is one in each folder.)"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

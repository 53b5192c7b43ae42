"""Where the tests find the smallest tables."""

import os

SF = "/root/testdata/sf0.001"


def has_tables() -> bool:
    return os.path.isdir(SF)

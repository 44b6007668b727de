"""Small tables for the suites."""

# 500 rows made by a rule; some keys repeat.
KV_ROWS = [((i * i // 5 + 3 * i) % 500, f"val_{(i * i // 5 + 3 * i) % 500}") for i in range(500)]
USERS = [(1, "A"), (2, "B"), (3, "A")]
CLICKS = [(1, 0), (2, 1), (1, 1), (2, 0), (1, 1)]
ARRAYS = [(1, [0, 1, 2]), (2, [3, 4, 5]), (3, [6, 7, 8])]
NULL_KEY_LINES = [
    "238\x01val_238", "\x01", "311\x01val_311", "\x01val_27", "\x01val_165", "\x01val_409", "255\x01val_255",
    "278\x01val_278", "98\x01val_98", "\x01val_484", "\x01val_265", "\x01val_193", "401\x01val_401",
    "150\x01val_150", "273\x01val_273", "224\x01", "369\x01", "66\x01val_66", "128\x01", "213\x01val_213",
    "146\x01val_146", "406\x01val_406", "\x01", "\x01", "\x01",
]
NESTED_SCHEMA = "a string, b array<string>, c array<map<string,string>>, d map<string,array<string>>"
NESTED_LINES = [
    "a0\x01b00\x02b01\x01c001\x04C001\x03c002\x04C002\x02c011\x04\\N\x03c012\x04C012"
    "\x01d01\x03d011\x04d012\x02d02\x03d021\x04d022",
    "a1\x01b10\x01c001\x04C001\x03c002\x04C002\x01d01\x03d011\x04d012\x02d02\x03\\N",
    "a2\x01\x01c001\x04\\N\x03c002\x04C002\x01d01\x03\\N\x04d012",
    "a3\x01\\N\x01\\N\x01\\N",
]


def text_lines(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))

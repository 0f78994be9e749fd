import hashlib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from logsieve.functions.scalars import (
    has_private_prefix, is_private_ip, iso_timestamp, json_len, md5_mod, printed_json, unit_hash,
)


def random_document(rng, depth=0):
    t = rng.random()
    if depth > 2 or t < 0.4:
        return rng.choice(["a,b:c", 'é"x\\', "😀", 5, True, None, "x\ny", -3, 2.5, "", "ends:"])
    if t < 0.7:
        return [random_document(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["k", "é", "a:b"]) + str(i): random_document(rng, depth + 1) for i in range(rng.randint(0, 3))}


def test_json_length_and_text_equal_python(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        document = {"r": random_document(rng)}
        text = json.dumps(document, ensure_ascii=False, separators=rng.choice([(",", ":"), (", ", ": ")]), sort_keys=True)
        rows.append((text, json.dumps(document, sort_keys=True)))
    df = spark.createDataFrame(rows, "j string, printed string")
    wrong = df.filter((json_len("j") != F.length("printed")) | (printed_json("j") != F.col("printed")))
    assert wrong.count() == 0


@pytest.mark.parametrize("modulus", [1000, 997])
def test_md5_mod_equals_python(spark, modulus):
    texts = ["", "iam.amazonaws.com", "é😀", "x" * 500] + [str(i) for i in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", md5_mod("t", modulus).alias("m")).collect()
    for r in got:
        assert r.m == int(hashlib.md5(r.t.encode()).hexdigest(), 16) % modulus


def test_private_addresses_equal_python(spark):
    rng = random.Random(5)
    ips = ["10.0.0.7", "172.32.0.1", "172.16.5.4", "192.168.1.9", "8.8.8.8", "ec2.amazonaws.com", "::1", "fc00::1",
           "fd12:3456::1", "fe80::1", "2001:db8::1", "2001:4860:4860::8888", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "",
           "192.0.0.9", "192.0.0.1", "100.64.0.1", "255.255.255.255", "2002::1", "2001::1", "01.2.3.4", "1.2.3",
           "2606:4700::1111", "::", "::2", "FE80::1", "10.0.0.256", "198.20.0.1", "198.19.255.255", "239.0.0.1"]
    ips += [".".join(str(rng.choice([0, 10, 127, 169, 172, 192, 198, 203, 16, 31, 168, 240, 51, 113, 2])) for _ in range(4))
            for _ in range(500)]

    def private(ip):
        try:
            return int(ipaddress.ip_address(ip).is_private)
        except ValueError:
            return 0

    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", is_private_ip("ip").alias("p")).collect()
    assert [(r.ip, r.p) for r in got] == [(i, private(i)) for i in ips]


def test_prefix_test_differs_where_it_should(spark):
    row = spark.createDataFrame([("172.32.0.1",)], "ip string").select(
        has_private_prefix("ip").alias("prefix"), is_private_ip("ip").alias("range")).first()
    assert (row.prefix, row.range) == (1, 0)


def test_strict_timestamps(spark):
    rows = [("2024-01-31T08:00:00Z",), ("2024-01-31 08:00:00",), ("2024-13-31T08:00:00Z",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(F.hour(iso_timestamp("t")).alias("h")).collect()
    assert [r.h for r in got] == [8, None, None, None, None]


def test_unit_hash_is_the_start_of_md5(spark):
    got = spark.range(20).select("id", unit_hash(F.lit("42"), F.col("id").cast("string")).alias("h")).collect()
    for r in got:
        assert r.h == float(int(hashlib.md5(f"42:{r.id}".encode()).hexdigest()[:13], 16))

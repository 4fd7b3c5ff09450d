"""Values that the queries' tables do not hold: nulls, odd texts and the edges of rules."""

import ipaddress
import random

from pyspark.sql import functions as F

from tilespan.functions import addresses, grid, rules, text
from tilespan.operators import config, headers, tasks, wizard


def column(spark, make, values, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_hosts_and_urls(spark):
    hosts = ["127.0.0.1", "10.1.2.3", "172.32.0.1", "169.254.169.254", "224.0.0.1", "0.0.0.0", "8.8.8.8", "240.0.0.1", "256.1.1.1", "01.2.3.4", "a.b", None]
    assert column(spark, lambda c: addresses.kind4(addresses.ipv4(c)), hosts) == ["loopback", "private", "public", "link_local", "multicast", "unspecified", "public", "reserved", None, None, None, None]
    assert column(spark, rules.bypasses_proxy, ["localhost", "192.168.1.1", "example.com", None]) == [True, True, False, False]
    urls = ["", None, "//h/x", "file:///etc", "http:///x", "http://u@h/", "http://h:x/", "https://h:443/a", "http://169.254.1.1/"]
    assert column(spark, rules.url_error, urls) == ["empty", "empty", "scheme", "scheme", "no_host", "user_info", "port", None, "blocked_address"]
    assert column(spark, rules.server_error, ["mts0", "https://h/{z}/{x}/{y}?k={credential}", None, "http:///{z}/{x}/{y}"]) == [None, None, "empty", "no_host"]
    assert column(spark, rules.server_list, [" a , ,b", None, ","]) == [["a", "b"], ["mts0", "mts1", "mts2", "mts3"], ["mts0", "mts1", "mts2", "mts3"]]
    assert column(spark, lambda c: rules.server_template(c, F.lit("s")), ["mts1", "t.example.com", "https://h/{z}/{x}/{y}"]) == ["https://mts1.googleapis.com/vt?lyrs=s&x={x}&y={y}&z={z}", "https://t.example.com/vt?lyrs=s&x={x}&y={y}&z={z}", "https://h/{z}/{x}/{y}"]


def test_values(spark):
    assert column(spark, rules.style_code, ["s", "Terrain", "nope", None]) == ["s", "t", "m", "m"]
    assert column(spark, rules.format_name, ["P", "x", None]) == ["png", None, None]
    assert column(spark, lambda c: rules.tint_error(c, F.lit("#fff,#000")), ["5", "5,", "x", "", None, "1,2"]) == [None, None, "not_a_number", "only_one", "only_one", "wrong_count"]
    assert column(spark, lambda c: rules.first_text(c, F.lit("b")), ["", "  ", None, " a "]) == ["b", "b", "b", "a"]
    one = spark.range(1).select(rules.bbox_error(F.lit(1.0), F.lit(0.0), F.lit(190.0), F.lit(170.0), True).alias("a"), rules.bbox_error(F.lit(float("nan")), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"), grid.max_zoom_3857(F.lit(0.0)).alias("c")).first()
    assert tuple(one) == (None, "not_a_number", 21)
    back = spark.range(1).select(grid.to_pixel(F.array(*map(F.lit, (10.0, 0.5, 0.0, 50.0, 0.0, -0.25))), F.lit(12.0), F.lit(49.0)).alias("p")).first().p
    assert tuple(back) == (4.0, 4.0)
    assert column(spark, text.log_field, ["a", "a b", 'x"y', ""]) == ["a", '"a b"', '"x\\"y"', '""']
    assert column(spark, lambda c: text.redact(c, "/home/someone"), ["at /home/someone/x", None]) == ["at ~/x", None]


def test_geotransform_and_epsg(spark):
    row = spark.range(1).select(
        headers.geotransform(F.lit(None).cast("array<double>"), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.0)), F.array(*map(F.lit, (2.0, 4.0, 0.0, 100.0, 50.0, 0.0)))).alias("a"),
        headers.geotransform(F.lit(None).cast("array<double>"), F.array(F.lit(0.0), F.lit(0.25), F.lit(0.0)), F.array(*map(F.lit, (2.0, 4.0, 0.0, 100.0, 50.0, 0.0)))).alias("b"),
        headers.epsg(F.lit(1), F.lit(32767), F.lit(4326)).alias("c"), headers.epsg(F.lit(2), F.lit(None).cast("int"), F.lit(4326)).alias("d"), headers.epsg(F.lit(None).cast("int"), F.lit(3857), F.lit(4326)).alias("e"),
    ).first()
    assert tuple(row) == ([99.0, 0.5, 0.0, 51.0, 0.0, -0.25], None, None, 4326, 3857)


def test_templates(spark):
    urls = ["https://h.example.com/5/3/4/9", "https://h.example.com/a?x=1&y=2&zoom=3#7", "https://h.example.com/99/99/99", "no url", None, "https://u:p@a.b.c/2/1/0.png"]
    rows = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    found = {r.id: (r.template, r.subdomains) for r in wizard.templates(rows, "id").collect()}
    assert found == {0: ("https://h.example.com/{z}/{x}/{y}/9", "a,b,c"), 1: ("https://h.example.com/a?x={x}&y={y}&zoom={z}#7", "a,b,c"), 5: ("https://u:p@a.b.c/{z}/{x}/{y}.png", "a,b,c")}
    assert found[1][0] == "https://h.example.com/a?x={x}&y={y}&zoom={z}#7" and 2 not in found and 3 not in found and 4 not in found


def test_templates_of_urls_with_many_numbers(spark):
    many = "/".join(f"a{i}/{i % 7}" for i in range(60))
    urls = [f"https://h/{many}", f"https://h/{many}/b/3/5/2.png", f"https://h/{many}?zoom=3&tilecol=5&row=2", "https://h/" + "/".join(["3/x"] * 20), "https://h/4/20/1?x=2", "https://h/4/a/2?x=20&y=3&x=2", "https://h/9/1"]
    found = {r.id: r.template for r in wizard.templates(spark.createDataFrame(list(enumerate(urls)), "id int, url string"), "id").collect()}
    assert found[1] == f"https://h/{many}/b/{{z}}/{{x}}/{{y}}.png" and found[2] == f"https://h/{many}?zoom={{z}}&tilecol={{x}}&row={{y}}"
    assert 0 not in found and found[3].startswith("https://h/{z}/x/{x}/x/{y}/x/3") and 6 not in found
    assert found[4] == "https://h/{z}/20/{y}?x={x}" and found[5] == "https://h/{z}/a/2?x=20&y={y}&x={x}"


def test_rate_keeps_one_older_sample(spark):
    rows = spark.sql("SELECT 1 AS task, timestamp_seconds(t) AS ts, b AS total FROM VALUES (0, 0), (10, 100), (11, 150), (12, 160), (20, 400) AS v(t, b)")
    assert [r.rate for r in tasks.trailing_rate(rows, "task").orderBy("ts").collect()] == [0.0, 10.0, 150 / 11, 160 / 12, 30.0]


def test_upsert_leaves_what_is_marked(spark):
    have = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    put = spark.createDataFrame([("a", "<kept>"), ("b", ""), ("c", None)], "key string, value string")
    assert {(r.key, r.value, r.changed) for r in config.upsert(have, put, "<kept>").collect()} == {("a", "1", False), ("b", "", True), ("c", None, True)}


def _kind_of(ip):
    for name, yes in (("link_local", ip.is_link_local), ("multicast", ip.is_multicast), ("unspecified", ip.is_unspecified), ("loopback", ip.is_loopback)):
        if yes:
            return name
    return "local" if ip.is_private or ip.is_reserved else "public"


def _held(ip):
    if ip.version == 4:
        return [ip]
    out = [x for x in (ip.ipv4_mapped, ip.sixtofour) if x is not None] + [*(ip.teredo or ())]
    if ip in ipaddress.ip_network("64:ff9b::/96"):
        out.append(ipaddress.ip_address(int(ip) & 0xFFFFFFFF))
    if not out and 1 < int(ip) <= 0xFFFFFFFF:
        out.append(ipaddress.ip_address(int(ip)))
    return out or [ip]


def test_addresses_as_the_standard_library_reads_them(spark):
    rng = random.Random(0)
    heads = [0, 1, 0x64FF9B, 0x0100, 0x2001, 0x20010DB8, 0x2002, 0x3FFF, 0xFC00, 0xFDFF, 0xFE80, 0xFEBF, 0xFEC0, 0xFF02, 0x2606, 0x4000, 0xA000, 0xF800]
    hosts = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    hosts += [f"{a}.{b}.{c}.{d}" for a, b in ((10, 1), (100, 64), (127, 9), (169, 254), (172, 16), (172, 32), (192, 0), (192, 168), (198, 18), (198, 51), (203, 0), (224, 1), (240, 0), (255, 255), (0, 0)) for c in (0, 2, 100, 113) for d in (0, 1, 9, 10, 11, 255)]
    for h in heads:
        for _ in range(25):
            bits = max(16, -(-h.bit_length() // 16) * 16)
            hosts.append(str(ipaddress.IPv6Address((h << (128 - bits)) | rng.getrandbits(128 - bits) >> rng.choice([0, 40, 90]))))
    hosts += [str(ipaddress.IPv6Address((0x64FF9B << 96) | rng.getrandbits(32))) for _ in range(20)] + [f"::ffff:{h}" for h in hosts[:40]] + [f"::{h}" for h in hosts[:40]] + ["::", "::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "FE80::1%eth0", "2001:1::1", "2001:1::2", "2001:3::9", "2001:4:112::5", "2001:20::1"]
    bad = ["", ":", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1::2::3", "12345::", "g::1", "::1.2.3", "::1.2.3.256", "1.2.3.4::", "1:2:3:4:5:6:7:1.2.3.4", "::%", "a.example", "1.2.3", "01.2.3.4", ":1:2:3:4:5:6:7:8", "::1:2:3:4:5:6:7:8"]
    found = column(spark, addresses.kinds, hosts + bad + [None])
    for host, got in zip(hosts, found, strict=False):
        want = [_kind_of(x) for x in _held(ipaddress.ip_address(host))]
        assert got is not None and [("local" if k in ("private", "reserved") else k) for k in got] == want, (host, got, want)
    for host, got in zip(bad, found[len(hosts) :], strict=False):
        try:
            ipaddress.ip_address(host)
            raise AssertionError(host)
        except ValueError:
            assert got is None, (host, got)


def test_urls_with_literal_hosts(spark):
    refused = ["http://[fe80::1]:80/", "http://[::ffff:169.254.169.254]:80/x", "http://[::169.254.169.254]/", "http://[64:ff9b::a9fe:a9fe]/", "http://[2002:a9fe:a9fe::]/", "http://[2001:0:a9fe:a9fe::1]/", "http://[::1]/", "http://[fd00::2]/"]
    assert column(spark, rules.url_error, refused) == ["blocked_address"] * 8
    assert column(spark, lambda c: rules.url_error(c, True), refused) == ["blocked_address"] * 6 + [None, None]
    other = ["http://[2606:4700::1111]/a", "http://[fe80::1/", "http://[zz]/", "http://a[::1]/", "http://h:80:90/", "http://h:+8/", "http://[2606:4700::1]:x/", "https://example.com:/p#frag", "http://u:p@[fe80::1]/"]
    assert column(spark, rules.url_error, other) == [None, "no_url", "no_url", "no_url", "port", "port", "port", None, "user_info"]
    assert column(spark, rules.bypasses_proxy, ["::1", "::ffff:10.0.0.1", "fe80::2%1", "2606:4700::1", "localhost.localdomain"]) == [True, True, True, False, True]
    assert column(spark, rules.fetched, [" http://h/p?q#f ", None]) == ["http://h/p?q", None]

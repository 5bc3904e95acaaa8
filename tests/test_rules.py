import pytest

from tidewatch.functions import rules

ROWS = [("a", "read", 0, "cat", "5", {"fd_path": ""}), ("b", "openat", 257, "curl", "x", {"fd_path": "/etc/passwd", "return_value": "-2"}), ("c", "execve", 59, "bash", "+7", {})]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "event_id string, syscall_name string, syscall_nr long, comm string, pid string, attributes map<string,string>")


@pytest.mark.parametrize(
    "text, ids",
    [
        ('attributes.fd_path = ""', "a"), ('not attributes.fd_path = ""', "bc"), ("attributes.fd_path startswith /etc", "b"), ("not attributes.fd_path startswith /etc", "ac"),
        ("pid = 5", "a"), ("pid in (5, 7, z)", "ac"), ("pid startswith 5", ""), ("return_value = -2", "b"), ("not return_value = -2", "ac"), ("comm in shells", "c"), ("comm IN (shells, cat)", "ac"),
        ("comm contains u or comm = cat and not pid = 5", "b"), ("(comm contains u or comm = cat) and not pid = 5", "b"), ("namespace = x", ""), ("attributes.fd_path startswithin (/etc, /tmp)", "b"),
    ],
)
def test_conditions(events, text, ids):
    tree = rules.parse(text, {"shells": ("bash", "sh")})
    assert "".join(sorted(r[0] for r in events.where(rules.compile_(tree, events.columns)).select("event_id").collect())) == ids


@pytest.mark.parametrize("text", ["nofield = 1", "comm like x", "comm =", "(comm = x", "comm = x y", "comm startswithin x", "and"])
def test_bad_conditions(text):
    with pytest.raises(ValueError):
        rules.parse(text)


def test_the_fields_of_the_language(events):
    names = "syscall_name syscall_nr event_id comm pid tid uid flags arg0 arg1 arg_flags return_value hostname namespace".split()
    names += [f"attributes.{n}" for n in "fd_path fd_resource_kind fd_sock_local_addr fd_sock_local_port fd_sock_remote_addr fd_sock_remote_port fd_sock_family".split()]
    assert len(names) == 21 and sorted(names) == sorted(rules.FIELDS)
    for n in names:
        events.where(rules.compile_(rules.parse(f"{n} = 1"), events.columns))
    for n in ("event_group", "pod_name", "container_id", "attributes.flags", "attributes.return_value", "attributes.else"):
        with pytest.raises(ValueError, match="unknown field"):
            rules.parse(f"{n} = 1")


def test_local_ends_of_sockets(spark):
    e = spark.createDataFrame([("a", {"fd_sock_local_addr": "10.0.0.1", "fd_sock_local_port": "22"}), ("b", {"fd_sock_local_port": "80"}), ("c", {})], "event_id string, attributes map<string,string>")
    held = lambda t: "".join(sorted(r[0] for r in e.where(rules.compile_(rules.parse(t), e.columns)).select("event_id").collect()))
    assert held("attributes.fd_sock_local_port in (22, 80)") == "ab" and held("attributes.fd_sock_local_addr startswith 10.") == "a" and held("not attributes.fd_sock_local_addr contains 0") == "bc"


def test_sql_says_what_columns_say(spark, events):
    texts = ["pid = 5", "not pid in (5, 7, z)", "return_value = -2", "not attributes.fd_path = ''", "comm in (bash, \"it's\", 'a\\\\b')", "comm contains u or comm = cat and not pid = 5", "attributes.fd_path startswithin (/etc, /tmp)", "namespace = x", "pid startswith 5", "arg_flags = x", ""]
    spec = {"groups": {"g": {"syscalls": ["read", "openat", "execve"]}}}
    given = ", ".join(p if p in events.columns else "cast(null as string)" for p in rules.PARAMETERS)
    for t in texts:
        loaded = rules.load(spec | {"rules": [{"name": "it's", "group": "g", "condition": t}]})
        rules.register_sql(spark, loaded)
        got = {r[0] for r in spark.sql(f"select event_id, rule_of({given}) as r from {{events}}", events=events).where("r = \"it's\"").collect()}
        assert got == {r["event_id"] for r in rules.classify(events, loaded).collect()}, t


def test_macros():
    assert rules.expand("m and long_m", {"m": "a", "long_m": "m or b"}) == "(a) and ((a) or b)"
    with pytest.raises(ValueError):
        rules.expand("x", {"x": "y", "y": "x"})
    assert rules.expand("a", {"unused": "unused"}) == "a"


BASE = {"lists": {"calls": ["read"]}, "groups": {"g": {"syscalls": "calls"}, "h": {"syscalls": ["read"]}}, "rules": [{"name": "r", "group": "g", "condition": "comm = cat"}]}


def test_load():
    r = rules.load(BASE)
    assert r.groups["g"].syscalls == ("read",) and rules.group_of_syscall(r) == {"read": "g"}


@pytest.mark.parametrize(
    "change",
    [
        {"lists": {"x": "no list"}}, {"macros": {"m": ""}}, {"groups": {"g": {}}}, {"groups": {"g": {"syscalls": "unknown"}}}, {"rules": [{"group": "g"}]}, {"rules": [{"name": "r", "group": "zz"}]},
        {"rules": [{"name": "r", "group": "g", "syscalls": ["read"]}]}, {"rules": [{"name": "r", "group": "g", "condition": "path = x"}]}, {"rules": [{"name": "r", "group": "g"}, {"name": "s", "group": "h"}]},
        {"rules": [{"name": "r", "group": "g"}, {"name": "r", "group": "g"}]},
    ],
)
def test_load_errors(change):
    with pytest.raises(ValueError):
        rules.load({**BASE, **change})


def test_first_rule_wins(events):
    spec = {"groups": {"g": {"syscalls": ["read", "openat", "execve"]}}, "rules": [{"name": "one", "group": "g", "condition": "comm = cat"}, {"name": "off", "group": "g", "enabled": False}, {"name": "rest", "group": "g"}]}
    got = {r["event_id"]: r["rule"] for r in rules.classify(events, rules.load(spec)).collect()}
    assert got == {"a": "one", "b": "rest", "c": "rest"}

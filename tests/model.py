"""Plain-Python models of the rules, used as the reference in tests."""

COOLDOWN = 900_000


def fold(rows, stored=None, cooldown=COOLDOWN):
    """rows: dicts with ip, name, time_ms, seq. Returns {ip: row} after applying in (time, seq) order."""
    state = dict(stored or {})
    for r in sorted(rows, key=lambda r: (r["time_ms"], r["seq"])):
        cur = state.get(r["ip"])
        if cur is None or (r["name"] != cur["name"] and r["time_ms"] > cur["time_ms"]) or (
            r["name"] == cur["name"] and r["time_ms"] - cooldown > cur["time_ms"]
        ):
            state[r["ip"]] = r
    return state


def _int32(x):
    return ((int(x) + 2**31) % 2**32) - 2**31


def js_hash24(s, shift):
    """``hash = c + ((hash << shift) - hash)`` with JavaScript number semantics:
    ``<<`` works on the 32-bit value, ``-`` and ``+`` on the full number; ``& 0xFFFFFF`` at the end."""
    h = 0
    for ch in s:
        h = ord(ch) + (_int32(_int32(h) << shift) - h)
    return _int32(h) & 0xFFFFFF


def colour(s, shift=5):
    c = format(js_hash24(s, shift), "X")
    return "#" + "0" * (6 - len(c)) + c

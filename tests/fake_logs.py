"""A log client without a network: two logs a block, twelve an answer at most."""

from tidewatch.sources.logs import TooLarge


def fetch(first, last):
    rows = [(b, i, f"0x{b % 3}", "swap" if i else "sync", str(b * i)) for b in range(first, last + 1) for i in (1, 0)]
    if len(rows) > 12:
        raise TooLarge
    return rows


def none_fit(first, last):
    raise TooLarge


def head():
    return 49


def creations(first, last):
    """A pool a block, with all topics; six an answer at most."""
    from tidewatch.functions import abi

    if last - first >= 6:
        raise TooLarge
    word = "{:064x}".format
    return [(b, 0, f"t{b}", "0x" + "a" * 40, [abi.event_topic(abi.CREATED["v2"]), "0x" + word(1), "0x" + word(50 + b)], "0x" + word(1000 + b) + word(b)) for b in range(first, last + 1)]

"""IP address checks and network keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_HEX = r"[0-9A-Fa-f]{1,4}"


def _groups(count: int) -> str:
    return _HEX + f"(:{_HEX})" + "{" + str(count - 1) + "}" if count else ""


def _ipv6_pattern() -> str:
    """Eight groups, or fewer around one '::' that stands for at least one; the last two may be dotted IPv4."""
    forms = [_groups(8), f"{_groups(6)}:{_IPV4}"]
    for before in range(8):
        head = _groups(before) + "::"
        after = 7 - before
        if after:
            forms.append(f"{head}({_HEX}(:{_HEX}){{0,{after - 1}}})?")
        else:
            forms.append(head)
        if after >= 2:
            hextets = f"({_HEX}:){{0,{after - 2}}}"
            forms.append(f"{head}{hextets}{_IPV4}")
    return f"({'|'.join(forms)})(%[^%]+)?"


IPV4_PATTERN = rf"^{_IPV4}\z"
IPV6_PATTERN = rf"^{_ipv6_pattern()}\z"


def is_ip(c: Column) -> Column:
    """True for a textual IPv4 or IPv6 address, false for anything else including NULL."""
    return F.coalesce(c.rlike(IPV4_PATTERN) | (c.contains(":") & c.rlike(IPV6_PATTERN)), F.lit(False))


def _ipv4_network(c: Column, prefix: int) -> Column:
    parts = F.split(c, r"\.")
    number = sum((parts[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)), parts[0].cast("bigint") * (1 << 24))
    masked = number.bitwiseAND(F.lit((0xFFFFFFFF << (32 - prefix)) & 0xFFFFFFFF).cast("bigint"))
    octets = [F.shiftright(masked, 24 - 8 * i).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for i in range(4)]
    return F.concat(F.concat_ws(".", *octets), F.lit(f"/{prefix}"))


def _ipv6_network(c: Column, prefix: int) -> Column:
    """A prefix of at most 32 bits keeps only the first two groups, the rest is one zero run."""
    address = F.split_part(c, F.lit("%"), F.lit(1))
    halves = F.split(address, "::")
    head = F.filter(F.split(halves[0], ":"), lambda g: g != "")
    tail = F.when(F.size(halves) > 1, F.filter(F.split(F.try_element_at(halves, F.lit(2)), ":"), lambda g: g != ""))
    tail_groups = F.coalesce(F.size(tail), F.lit(0)) + F.when(address.contains("."), 1).otherwise(0)
    first = F.coalesce(F.try_element_at(head, F.lit(1)), F.lit("0"))
    second_of_gap = F.when((F.size(head) == 0) & (tail_groups == 7), F.try_element_at(tail, F.lit(1)))
    second = F.coalesce(F.try_element_at(head, F.lit(2)), second_of_gap, F.lit("0"))

    def masked(group: Column, bits: int) -> Column:
        mask = (0xFFFF << (16 - bits)) & 0xFFFF
        return F.conv(group, 16, 10).cast("bigint").bitwiseAND(F.lit(mask).cast("bigint"))

    high, low = masked(first, min(prefix, 16)), masked(second, max(prefix - 16, 0))
    text = (
        F.when((high == 0) & (low == 0), "::")
        .when(low == 0, F.concat(F.lower(F.hex(high)), F.lit("::")))
        .otherwise(F.concat(F.lower(F.hex(high)), F.lit(":"), F.lower(F.hex(low)), F.lit("::")))
    )
    return F.concat(text, F.lit(f"/{prefix}"))


def asset_key(src_ip: Column, group_by: str = "src_ip", prefix: int = 24) -> Column:
    """The address itself, or the network that holds it; text that is no address stays as it is."""
    if group_by == "src_ip":
        return src_ip.cast("string")
    return (
        F.when(src_ip.rlike(IPV4_PATTERN), _ipv4_network(src_ip, prefix))
        .when(is_ip(src_ip), _ipv6_network(src_ip, prefix))
        .otherwise(src_ip)
    )

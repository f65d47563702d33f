"""Names, paths, log lines and validation as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 20


def natural_key(name: Column) -> Column:
    """A string whose order is the natural order of names: numbers count by value, letters without case."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, _DIGITS, "0")).otherwise(F.lower(p))), "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(name: Column) -> Column:
    """The name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_tiff(name: Column) -> Column:
    return ~name.startswith(".") & F.lower(name).rlike(r"\.tiff?$")


def _tokens(name: Column) -> Column:
    return F.split(stem(name), "_")


def frame_number(name: Column) -> Column:
    """The number in the first token that holds ``stack``; null without one."""
    token = F.get(F.filter(_tokens(name), lambda t: t.contains("stack")), 0)
    return F.try_to_number(F.regexp_extract(token, r"^.{5}(\d+)$", 1), F.lit("9" * 18)).cast("long")


def name_part(name: Column, part: str) -> Column:
    """``camera``, ``channel`` or ``wavelength`` of a file name; each token is one of them at most and later tokens win."""
    is_camera = lambda t: t.contains("Cam")
    is_channel = lambda t: ~is_camera(t) & F.lower(t).contains("ch")
    is_wave = lambda t: ~is_camera(t) & ~F.lower(t).contains("ch") & F.lower(t).contains("nm")
    test = {"camera": is_camera, "channel": is_channel, "wavelength": is_wave}[part]
    found = F.filter(_tokens(name), test)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def wavelength_nm(token: Column) -> Column:
    return F.regexp_extract(F.lower(token), r"^(\d+)nm", 1).try_cast("int")


def experiment_id(directory: Column) -> Column:
    return F.md5(directory)


def chunk_key(experiment: Column, frame: Column, stack: Column, wavelength: Column, index: Column) -> Column:
    """``experiment_frame[_stack]_wavelength_index``; a stack of -1 is left out."""
    return F.concat_ws("_", experiment, frame.cast("string"), F.when(stack != -1, stack.cast("string")), wavelength.cast("string"), index.cast("string"))


def numbered(prefix: str, number: Column, count: int) -> Column:
    """``prefix`` and the number, padded to the width of the last one and to three digits at least."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), max(3, len(str(count - 1))), "0"))


def thresholds(text: Column) -> Column:
    """Integers of a comma-separated list; blank entries are passed over, blank text is null."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.transform(items, lambda x: x.cast("int")))


def plain_line(line: Column) -> Column:
    """A terminal line without colour codes and trailing space; carriage returns end lines."""
    without = F.regexp_replace(line, r"\x1B\[[0-?]*[ -/]*[@-~]", "")
    return F.rtrim(F.regexp_replace(F.regexp_replace(without, r"\r\n?", "\n"), r"[\s]+$", ""))


def progress(line: Column) -> Column:
    """(event, item, done, total) of a progress line; event is null for other lines."""
    saving = F.regexp_extract(line, r"^Saving to (.+)$", 1)
    saved = F.regexp_extract(line, r"^Saved features to (.+)$", 1)
    count = r"^\[[^\]]+\] Processing (\S+) \((\d+)/(\d+)\)$"
    matched = F.regexp_extract(line, r"^Matched (\S+ -> \S+)", 1)
    event = F.when(saving != "", "saving").when(saved != "", "saved").when(F.regexp_extract(line, count, 1) != "", "processing").when(matched != "", "matched")
    item = F.when(saving != "", stem(base_name(saving))).when(saved != "", stem(base_name(saved))).when(F.regexp_extract(line, count, 1) != "", F.regexp_extract(line, count, 1)).when(matched != "", matched)
    return F.struct(event.alias("event"), item.alias("item"), F.regexp_extract(line, count, 2).try_cast("int").alias("done"), F.regexp_extract(line, count, 3).try_cast("int").alias("total"))


def completed(line: Column) -> Column:
    """The folder that a plain log line reports as completed; null for other lines."""
    name = F.trim(F.regexp_extract(line, r"^\[(?:process-features|segmentation|tracking|probmap)\] Completed (.+)$", 1))
    return F.when(name != "", name)


def matched_pair(line: Column) -> Column:
    """The pair of time points that a plain log line reports as matched; null for other lines."""
    pair = F.regexp_extract(line, r"^(?:\[tracking\] )?Matched (\S+ -> \S+)", 1)
    return F.when(pair != "", pair)


def reported(line: Column) -> Column:
    """What a plain log line reports as done: the path of a saved file, a completed folder or a matched pair; null for other lines."""
    saved = F.trim(F.regexp_extract(line, r"Saved features to\s+(.+)$", 1))
    return F.coalesce(F.when(saved != "", saved), completed(line), matched_pair(line))


def dataset_name_ok(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~name.isin(".", "..")


def directory_name_problem(name: Column) -> Column:
    """Why a directory can't have this name; null if it can."""
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "blank")
        .when(name.contains("\x00"), "nul")
        .when(name.isin(".", ".."), "reserved")
        .when(name.contains("/") | name.contains("\\"), "separator")
        .when(name.startswith("."), "hidden")
    )


def client_id_ok(client: Column) -> Column:
    return F.length(F.trim(client)).between(8, 128) & ~client.contains("\x00")


# Address blocks of the public registries of special-purpose addresses that are private or of a link.
_PRIVATE_4 = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4".split()
_PUBLIC_4 = "192.0.0.9/32 192.0.0.10/32".split()
_PRIVATE_6 = "::/128 ::1/128 ::ffff:0:0/96 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10".split()
_PUBLIC_6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()


def _within(high: Column, low: Column, blocks: list[str]) -> Column:
    """Whether an address, given as two numbers of half its bits, lies in one of the blocks."""
    found = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        half = net.max_prefixlen // 2
        a, b = int(net.network_address), int(net.broadcast_address)
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        if net.prefixlen <= half:
            # both ends have the same sign in two's complement, as no block crosses the middle
            found = found | high.between(signed(a >> half), signed(b >> half))
        else:
            found = found | (high == signed(a >> half)) & low.between(signed(a & (1 << half) - 1), signed(b & (1 << half) - 1))
    return found


def ip_class(address: Column, own: list[str] | None = None) -> Column:
    """Local (loopback, or one of the server's ``own`` addresses), Local network, Remote, or Unknown for what is no address."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(address)), r"%.*$", ""), r"^::ffff:(?=\d+\.)", "")
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    is_4 = plain.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    bytes_4 = F.transform(F.split(plain, r"\."), lambda p: p.try_cast("long"))
    high_4, low_4 = bytes_4[0] * 256 + bytes_4[1], bytes_4[2] * 256 + bytes_4[3]
    ends = F.split(plain, "::")
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    first, last = groups(ends[0]), F.when(F.size(ends) > 1, groups(F.get(ends, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    room = 8 - F.size(first) - F.size(last)
    is_6 = plain.rlike(r"^[0-9a-f:]+$") & ~plain.rlike(r"[0-9a-f]{5}|:::|^:[^:]|[^:]:$") & (((F.size(ends) == 1) & (room == 0)) | ((F.size(ends) == 2) & (room >= 1)))
    filled = F.concat(first, F.array_repeat(F.lit("0"), F.greatest(room, F.lit(0))), last)
    half = lambda k: F.conv(F.array_join(F.transform(F.slice(filled, k, 4), lambda g: F.lpad(g, 4, "0")), ""), 16, -10).cast("long")
    high_6, low_6 = half(1), half(5)
    near = F.when(is_4, _within(high_4, low_4, _PRIVATE_4) & ~_within(high_4, low_4, _PUBLIC_4)).otherwise(_within(high_6, low_6, _PRIVATE_6) & ~_within(high_6, low_6, _PUBLIC_6))
    return (
        F.when(address.isNull() | ~(is_4 | is_6), "Unknown")
        .when(plain.isin(*(own or [])) | (is_4 & (bytes_4[0] == 127)) | (is_6 & (high_6 == 0) & (low_6 == 1)), "Local")
        .when(near, "Local network")
        .otherwise("Remote")
    )


def flag(value: Column, default: bool) -> Column:
    """A query parameter as boolean: the default if it is null, an error if it is neither yes nor no."""
    v = F.lower(F.trim(value))
    yes, no = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")
    return F.when(value.isNull(), default).when(v.isin(*yes), True).when(v.isin(*no), False).otherwise(F.raise_error(F.concat(F.lit("Invalid boolean: "), value)).cast("boolean"))


def bounded_int(value: Column, default: int, low: int, high: int) -> Column:
    """A query parameter as an integer: the default if it is null, an error if it is none or out of bounds."""
    number = F.when(F.trim(value).rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(F.trim(value), "_", "").try_cast("long"))
    return F.when(value.isNull(), F.lit(default).cast("long")).when(number.between(low, high), number).otherwise(F.raise_error(F.concat(F.lit("Invalid number: "), value)).cast("long"))


def pca_components(folder: Column) -> Column:
    """The number in the name of a folder of components; null if it is none."""
    return F.regexp_extract(folder, r"^pca_(\d+)$", 1).try_cast("int")


def positive_thresholds(text: Column) -> Column:
    """Thresholds between commas, null if there are none; an error if one is no positive number."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    numbers = F.transform(parts, lambda t: t.try_cast("int"))
    wrong = F.exists(numbers, lambda n: F.coalesce(n <= 0, F.lit(True)))
    return F.when(F.size(parts) == 0, F.lit(None).cast("array<int>")).when(wrong, F.raise_error(F.lit("thresholds must be positive")).cast("array<int>")).otherwise(numbers)


def placed(template: Column, values: dict[str, Column]) -> Column:
    """A page with its placeholders replaced by escaped texts."""
    for name, value in values.items():
        safe = value
        for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            safe = F.replace(safe, F.lit(raw), F.lit(escaped))
        template = F.replace(template, F.lit(name), safe)
    return template


def casefold_key(name: Column) -> Column:
    """Order by letters whatever their case, then as written."""
    return F.struct(F.lower(F.regexp_replace(name, "ß", "ss")).alias("folded"), name.alias("raw"))


def job_title(kind: Column) -> Column:
    words = F.filter(F.split(F.coalesce(kind, F.lit("")), r"[-_]+"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return F.when(title == "", "Job").otherwise(title)


def output_path(root: Column, kind: str, item: Column | None = None) -> Column:
    """Where a result of a kind goes below ``root``."""
    places = {"lr_feats": ("lr_feats", ".npy"), "raw": ("raw", ".tif"), "hr_feats": ("hr_feats", ""), "seg_voronoi": ("seg_voronoi", ".tif"), "seg_probmap": ("seg_probmap", ".tif"), "tracks": ("tracks.csv", None), "norm": ("norm_per_vol.txt", None)}
    folder, suffix = places[kind]
    return F.concat_ws("/", root, F.lit(folder)) if suffix is None or item is None else F.concat(F.concat_ws("/", root, F.lit(folder), item), F.lit(suffix))


def preview(items: Column, most: int = 3) -> Column:
    """The first few items; dots if there are more."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, "...").otherwise(""))

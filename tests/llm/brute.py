"""Plain single-process versions of the operators, to hold results against."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near(docs, percent=85):
    """{doc_id: (n_shingles, component_id)} from all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[:i]}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs, length=400):
    """[(doc_id, n_bytes, n_removed, n_spans, sha256)] with every window of every text counted."""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_rules(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def tokens(docs, path, end=1):
    from tokenizers import Tokenizer

    own, start, out = Tokenizer.from_file(path), 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0], x[1] or "")):
        ids = own.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def fill_level(sizes, weights=(1, 2, 3), most=3):
    """{source: target} by repeated sharing; sizes {source: words}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    total = sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else level * w[s] for s in order}
        capped |= over


def reputation(pages, outcomes, suffix_of, domain_of, host_of, z=1.64, most=1000.0, least=1.0):
    """{host: (mean, lower)} of the beta-binomial posteriors along host, domain and suffix."""
    bad = collections.defaultdict(list)
    for page, b in outcomes:
        if b is not None:
            bad[page].append(b)
    hosts = {}
    for page, url in pages:
        n, k = hosts.get(host_of(url), (0, 0))
        hosts[host_of(url)] = (n + len(bad[page]), k + sum(bad[page]))
    total = sum(n for n, _ in hosts.values())
    corpus = sum(k for _, k in hosts.values()) / total if total else 0.0

    def posterior(groups, parent):
        seen = [(n, k / n, parent[g]) for g, (n, k) in groups.items() if n]
        room = sum((n - 1) * m * (1 - m) for n, _, m in seen)
        rho = max((sum(n * (r - m) ** 2 for n, r, m in seen) - sum(m * (1 - m) for *_, m in seen)) / room, 0.0) if room > 0 else 0.0
        strength = max(least, min(most, 1 / rho - 1)) if rho > 0 else most
        return {g: ((k + strength * parent[g]) / (n + strength), strength) for g, (n, k) in groups.items()}

    def summed(of):
        out = {}
        for h, (n, k) in hosts.items():
            a, b = out.get(of(h), (0, 0))
            out[of(h)] = (a + n, b + k)
        return out

    suffixes = posterior(summed(suffix_of), dict.fromkeys(map(suffix_of, hosts), corpus))
    domains = posterior(summed(domain_of), {domain_of(h): suffixes[suffix_of(h)][0] for h in hosts})
    found = posterior(hosts, {h: domains[domain_of(h)][0] for h in hosts})
    return {h: (m, m - z * (m * (1 - m) / (hosts[h][0] + s + 1)) ** 0.5) for h, (m, s) in found.items()}


def removed_words(docs, least=10):
    """{doc_id: words in lines that ``least`` documents of the same source hold}."""
    normal = lambda x: " ".join(WORD.findall(x.translate(LOWER).translate(str.maketrans("123456789", "0" * 9))))
    held = collections.defaultdict(set)
    lines = [(d, s, [normal(x) for x in (t or "").split("\n")]) for d, t, s in docs]
    for d, s, own in lines:
        for x in own:
            held[s, x].add(d)
    return {d: sum(len(x.split(" ")) for x in own if x and len(held[s, x]) >= least) for d, s, own in lines}

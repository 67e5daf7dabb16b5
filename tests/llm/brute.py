"""Plain versions that compare everything with everything."""


def linked_groups(rows, size=3, percent=90):
    """doc_id: (doc_id, n_shingles, component_id)."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        width = min(size, len(words))
        sets[doc_id] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    return {i: (i, len(s), root(i)) for i, s in sets.items()}


def best_products(vectors, is_query, k):
    """Rows query_id, rank, vec_id, score; vectors: (id, list of integers)."""
    out = []
    for query_id, q in vectors:
        if is_query(query_id):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != query_id and len(v) == len(q))
            out += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def _closest(vector, entries):
    """(squared distance, index), ties to the lower index."""
    return min((sum((a - b) ** 2 for a, b in zip(vector, e)), i) for i, e in enumerate(entries))


def _moved(vectors, places, entries):
    out = []
    for i, e in enumerate(entries):
        own = [v for v, p in zip(vectors, places) if p == i]
        out.append([sum(c) // len(own) for c in zip(*own)] if own else e)
    return out


def coded(rows, parts, entries, rounds):
    """Sorted (vec_id, code, error, label_error) and the codebooks; rows: (vec_id, list of integers, label)."""
    seeds = sorted({i: min(v for j, v, _ in rows if j == i) for i, _, _ in rows if i is not None}.items())[:entries]
    width = len(rows[0][1]) // parts
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(parts):
        cut = [v[p * width : (p + 1) * width] for _, v, _ in rows]
        book = [v[p * width : (p + 1) * width] for _, v in seeds]
        for _ in range(rounds):
            book = _moved(cut, [_closest(v, book)[1] for v in cut], book)
        for k, v in enumerate(cut):
            distance, place = _closest(v, book)
            codes[k].append(place)
            errors[k] += distance
        books.append(book)
    labels = {}
    for (_, _, label), e in zip(rows, errors):
        labels[label] = labels.get(label, 0) + e
    out = [(i, "".join(f"{c:02x}" for c in code), e, labels[label]) for (i, _, label), code, e in zip(rows, codes, errors)]
    return sorted(out, key=repr), books


def clustered(rows, clusters, rounds, seed):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia) and the centroids; rows: (vec_id, list of integers)."""
    import hashlib

    key = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    first = {i: min(v for j, v in rows if j == i) for i, _ in rows if i is not None}
    centroids = [first[i] for i in sorted(first, key=key)[:clusters]]
    vectors = [v for _, v in rows]
    for _ in range(rounds):
        centroids = _moved(vectors, [_closest(v, centroids)[1] for v in vectors], centroids)
    found = [_closest(v, centroids) for v in vectors]
    own = {}
    for d, c in found:
        own[c] = own.get(c, 0) + d
    out = [(i, c, d, own[c], sum(own.values())) for (i, _), (d, c) in zip(rows, found)]
    return sorted(out, key=repr), centroids

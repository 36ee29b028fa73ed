"""Plain-Python statements of the sequential rules, used as the expectation."""


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def brute_tracks(frames, dets):
    """frames: sorted ids of one feed; dets: {frame: [(det_id, box)]} -> {det_id: track number}, live tracks per frame."""
    tracks, number, out, live = {}, 0, {}, {}
    for f in frames:
        used, fresh = set(), []
        for det, box in dets.get(f, []):
            best, best_iou = None, 0.0
            for t, (tbox, _) in tracks.items():
                if t not in used and overlap(box, tbox) > best_iou:
                    best, best_iou = t, overlap(box, tbox)
            if best is not None and best_iou >= 0.3:
                tracks[best] = (box, f)
                used.add(best)
                out[det] = best
            else:
                fresh.append((det, box))
        for det, box in fresh:
            tracks[number] = (box, f)
            out[det] = number
            number += 1
        tracks = {t: v for t, v in tracks.items() if f - v[1] <= 5}
        live[f] = sorted(tracks)
    return out, live


def brute_cooldown(alerts, wait):
    """alerts: [(time, keys)] in order -> decisions."""
    last, out = {}, []
    for t, keys in alerts:
        ok = all(t - last[k] >= wait for k in keys if k in last)
        if ok:
            for k in keys:
                last[k] = t
        out.append(ok)
    return out

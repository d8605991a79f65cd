"""Random tracks and plain sequential state machines to compare the set-oriented operators with."""

import math
import random

RADIUS = 6_371_008.8
US = 1_000_000
STOPS = [("a", 0, 10.0, 20.0, 400.0), ("b", 1, 10.05, 20.0, 120.0), ("c", 2, 10.1, 20.0, 400.0)]


def meters(lat1, lon1, lat2, lon2):
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(a)))


def random_track(seed, n, ship="SHP-TST-0001", step=(20, 400)):
    """A truck wandering between stops with repeats, noise, flapping at fences and uncertain fixes."""
    rng, at, rows = random.Random(seed), 1_788_220_800, []
    for i in range(n):
        at += 0 if rng.random() < 0.03 else rng.randint(*step)
        stop = STOPS[min(2, i * 3 // n)]
        lat = stop[2] + (rng.random() * 0.012 if rng.random() < 0.5 else rng.random() * 0.003)
        if rng.random() < 0.1:
            lat += 0.2
        rows.append(
            dict(
                event_id=i, shipment_id=ship, lane="TST", occurred_us=at * US, received_us=(at + rng.randint(0, 900)) * US, lat=lat, lon=20.0,
                speed_kph=None if rng.random() < 0.05 else rng.choice([0.0, 3.0, 30.0, 70.0]),
                accuracy_m=None if rng.random() < 0.1 else rng.choice([3.0, 25.0, 40.0, 90.0, 160.0]),
                temp_c=rng.choice([4.0, 5.0, 9.5, 12.0]), setpoint_c=None if rng.random() < 0.02 else 4.0,
            )
        )
    return rows


def per_instant(rows):
    out, last = [], None
    for r in sorted(rows, key=lambda r: (r["occurred_us"], r["event_id"])):
        if r["occurred_us"] != last:
            out.append(r)
            last = r["occurred_us"]
    return out


class Fence:
    def __init__(self):
        self.inside = self.departed = False
        self.entered = self.left = self.arrived = None
        self.proofs = {}

    def apply(self, r, lat, lon, radius, dwell=180):
        if self.departed or (r["accuracy_m"] is not None and r["accuracy_m"] > radius * 0.25):
            return
        d, at = meters(r["lat"], r["lon"], lat, lon), r["occurred_us"]
        now = d <= radius * 1.25 if self.inside else d < radius
        if now and not self.inside:
            self.entered = at
        if self.inside and not now:
            self.left = at
        self.inside = now
        if now and self.arrived is None and at - self.entered >= dwell * US:
            self.arrived = self.entered
            self.proofs["in"] = r["event_id"]
        if not now and self.arrived is not None and self.left is not None and self.left > self.arrived and at - self.left >= dwell * US:
            self.departed = True
            self.proofs["out"] = r["event_id"]


def run_fences(rows):
    """(visits, published estimates) of one shipment, sequentially."""
    fences = {s[0]: Fence() for s in STOPS}
    speed, last, target, held, out = None, None, None, None, []
    for r in per_instant(rows):
        for stop in STOPS:
            fences[stop[0]].apply(r, *stop[2:])
        gap = 0 if last is None else (r["occurred_us"] - last) / US
        last = r["occurred_us"]
        if r["speed_kph"] is not None and r["speed_kph"] >= 5:
            speed = r["speed_kph"] if speed is None else speed + (1 - 2 ** (-gap / 300)) * (r["speed_kph"] - speed)
        if any(f.inside for f in fences.values()):
            continue
        ahead = [s for s in STOPS if fences[s[0]].arrived is None]
        if not ahead:
            continue
        km = meters(r["lat"], r["lon"], ahead[0][2], ahead[0][3]) / 1000 * 1.3
        estimate = r["occurred_us"] + math.floor(km / max(5, 60 if speed is None else speed) * 3600 + 0.5) * US
        previous = held if target == ahead[0][0] else None
        if previous is None or abs(estimate - previous) >= 120 * US:
            target, held = ahead[0][0], estimate
            out.append((target, r["event_id"], estimate, previous))
    visits = {
        k: (f.arrived, f.proofs["in"], f.left if f.departed else None, f.proofs.get("out"))
        for k, f in fences.items()
        if f.arrived is not None
    }
    return visits, out


def run_condition(rows, judge, hold_s):
    """(onset, raised at, worst when over, cleared at) of each incident; judge gives None, or (breach, excess)."""
    since = worst = raised = None
    out = []
    for r in per_instant(rows):
        verdict = judge(r)
        if verdict is None:
            continue
        breach, excess = verdict
        if breach:
            since = r["occurred_us"] if since is None else since
            worst = excess if worst is None else max(worst, excess)
            if raised is None and r["occurred_us"] - since >= hold_s * US:
                raised = r["occurred_us"]
        else:
            if raised is not None:
                out.append((since, raised, worst, r["occurred_us"]))
            since = worst = raised = None
    if raised is not None:
        out.append((since, raised, worst, None))
    return out

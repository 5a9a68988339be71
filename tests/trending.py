"""An events table whose prices trend, turn and stand still, for rules that a still market never meets."""

import numpy as np
import pandas as pd

HOUR = 3600


def write_events(folder: str, hours: int = 1500, seed: int = 4, symbols: tuple[str, ...] = ("click", "error", "purchase", "signup", "view")) -> str:
    """Four ticks an hour of waves upon trends that turn, in ``folder``/events.parquet."""
    rng = np.random.default_rng(seed)
    frames = []
    for k, symbol in enumerate(symbols):
        n = hours * 4
        slope = np.repeat(rng.choice([-0.04, -0.015, 0.0, 0.02, 0.05], n // 600 + 1), 600)[:n]
        wave = 7 * np.sin(np.arange(n) / (23 + 5 * k)) + 3 * np.sin(np.arange(n) / 9)
        price = 300 + np.cumsum(slope + rng.normal(0, 0.35, n)) + wave
        ts = np.datetime64("2024-01-01", "us") + (np.arange(n) * HOUR // 4 * 1_000_000 + rng.integers(0, 800_000_000, n)).astype("timedelta64[us]")
        frames.append(pd.DataFrame({"ts": ts, "event_type": symbol, "value": np.round(np.maximum(price, 1.0), 2)}))
    out = pd.concat(frames, ignore_index=True)
    # Some bars have more ticks than others, so that volumes differ.
    out = pd.concat([out, out.sample(frac=0.4, random_state=seed)], ignore_index=True).sort_values(["event_type", "ts"], ignore_index=True)
    out["ts"] = out["ts"] + pd.to_timedelta(np.arange(len(out)) % 7, unit="us")
    out.insert(0, "event_id", np.arange(len(out)))
    out["user_id"], out["props"] = 1, "{}"
    out[["event_id", "ts", "user_id", "event_type", "value", "props"]].to_parquet(f"{folder}/events.parquet", index=False, coerce_timestamps="us")
    return folder

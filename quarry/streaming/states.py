"""Stateful processors of the streams: what is kept for each key, and what a batch of its rows changes.

State is read and written while a handler is called, never in a generator that runs later, when the key at hand
may be another. State lies in the state store and survives restarts; the store must be of the kind that holds several states a
key, which `stateful` sets for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Names of the phases of an audit, and what a progress has before its first phase.
PHASE_NAMES = {0: "初始化", 1: "代码分析", 2: "漏洞扫描", 3: "Agent验证", 4: "利用链验证", 5: "生成报告"}
UNNAMED_PHASE = "运行中"
#: Fixed value: messages that a progress keeps, the last ones.
MESSAGES = 500


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: What is kept of an event that waits and of a user's balance, packed.
EVENT = np.dtype([("no_user", "?"), ("user", "<i8"), ("at", "<i8"), ("seq", "<i8"), ("delta", "<i8")])
HELD = np.dtype([("no_user", "?"), ("user", "<i8"), ("balance", "<i8")])


class BalanceFold(StatefulProcessor):
    """Balances of a bucket of users (key: its number), events folded in the order of their times across batches.

    An event waits in a buffer until the watermark has passed its time, so that none can come before it any more;
    a timer at the earliest waiting event then folds all that may be. The buffer holds what arrives within the lateness.
    A call to the state store takes longer than the fold of many events, so the users of a bucket share each call: what
    waits is kept as a packed array a batch, balances as one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.balances = handle.getValueState("balances", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """A timer at this millisecond, unless an earlier one is set."""
        if self.timer.exists():
            set_at = self.timer.get()[0]
            if set_at <= at:
                return
            self.handle.deleteTimer(set_at)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for frame in rows:
            frame = frame[frame["seq"].notna()]
            part = np.empty(len(frame), EVENT)
            for c in EVENT.names:
                # whole numbers again: a null in a batch makes pandas' columns floating
                part[c] = frame[c].fillna(0).astype(EVENT[c]).to_numpy()
            parts.append(part)
        events = np.concatenate(parts) if parts else np.empty(0, EVENT)
        if len(events):
            self.waiting.appendValue((events.tobytes(),))
            self._wake(int(events["at"].min()) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = np.concatenate([np.frombuffer(bytes(x[0]), EVENT) for x in self.waiting.get()])
        ready, rest = waiting[waiting["at"] <= passed], waiting[waiting["at"] > passed]
        self.timer.clear()
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self._wake(int(rest["at"].min()) // 1000)
        else:
            self.waiting.clear()
        if not len(ready):
            return iter(())
        ready = ready[np.lexsort([ready[c] for c in ("delta", "seq", "at", "user", "no_user")])]
        known = np.frombuffer(bytes(self.balances.get()[0]), HELD) if self.balances.exists() else np.empty(0, HELD)
        held = {(n, u): b for n, u, b in known.tolist()}
        owner, balance, balances, rejections = None, 0, [], []
        for no_user, user, _, _, delta in ready.tolist():
            if owner != (no_user, user):
                if owner is not None:
                    held[owner] = balance
                owner = (no_user, user)
                balance = held.get(owner, 0)
            rejected = balance + delta < 0
            balance += 0 if rejected else delta
            balances.append(balance)
            rejections.append(rejected)
        held[owner] = balance
        self.balances.update((np.array([(*o, b) for o, b in held.items()], HELD).tobytes(),))
        users = pd.Series(ready["user"], dtype="Int64").mask(ready["no_user"])
        return iter([pd.DataFrame({"user_id": users, "seq": ready["seq"].copy(), "delta": ready["delta"].copy(), "balance": balances, "rejected": rejections})])

    def close(self) -> None:
        pass


class ReviewState(StatefulProcessor):
    """Status, severity and notes of a finding under review; each field follows the latest action on it, in the order of
    time and sequence, however the actions arrive. `version` grows with every action."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "at long, seq long, value string")
        self.severity = handle.getValueState("severity", "at long, seq long, value string")
        self.notes = handle.getListState("notes", "at long, seq long, reason string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version = self.version.get()[0] if self.version.exists() else 0
        best = {f: tuple(state.get()) if state.exists() else None for f, state in (("status", self.status), ("severity", self.severity))}
        for frame in rows:
            notes = []
            for at, seq, kind, severity, reason in zip(frame["at"].tolist(), frame["seq"].tolist(), frame["action_type"], frame["new_severity"], frame["reason"], strict=True):
                version += 1
                said = {"confirm": ("status", "confirmed"), "reject": ("status", "rejected"), "upgrade": ("severity", severity), "downgrade": ("severity", severity)}.get(kind)
                if kind == "add_note":
                    notes.append((at, seq, reason))
                elif said and said[1] is not None and (best[said[0]] is None or (at, seq) > best[said[0]][:2]):
                    best[said[0]] = (at, seq, said[1])
            if notes:
                self.notes.appendList(notes)
        for field, state in (("status", self.status), ("severity", self.severity)):
            if best[field]:
                state.update(best[field])
        self.version.update((version,))
        notes = sorted((tuple(n) for n in self.notes.get()), key=lambda n: n[:2])
        return iter([pd.DataFrame([{"finding_id": key[0], "status": best["status"] and best["status"][2], "severity": best["severity"] and best["severity"][2], "notes": [n[2] for n in notes], "version": version}])])

    def close(self) -> None:
        pass


class AuditProgress(StatefulProcessor):
    """Phase, percent and the last messages of a running audit. A row of phase -1 adds its message and leaves the rest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "seq long, phase int, name string, percent double")
        self.messages = handle.getListState("messages", "seq long, message string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        progress = tuple(self.progress.get()) if self.progress.exists() else (None, 0, UNNAMED_PHASE, 0.0)
        version = self.version.get()[0] if self.version.exists() else 0
        ring = [tuple(m) for m in self.messages.get()]
        for frame in rows:
            for seq, phase, percent, message in zip(frame["seq"].tolist(), frame["phase"].tolist(), frame["percent"].tolist(), frame["message"], strict=True):
                version += 1
                ring.append((seq, message))
                if phase != -1 and (progress[0] is None or seq >= progress[0]):
                    progress = (seq, phase, PHASE_NAMES.get(phase, message), percent)
            ring = sorted(ring, key=lambda m: m[0])[-MESSAGES:]  # a ring of bounded size, whatever a batch brings
        self.messages.put(ring)
        if progress[0] is not None:
            self.progress.update(progress)
        self.version.update((version,))
        return iter([pd.DataFrame([{"audit_id": key[0], "current_phase": progress[1], "phase_name": progress[2], "progress_percent": float(progress[3]), "messages": [m[1] for m in ring], "version": version}])])

    def close(self) -> None:
        pass

"""Settings of replicas, with their defaults and rules, and errors by kind."""

from __future__ import annotations

from dataclasses import dataclass, field


class InvalidArgument(ValueError):
    """Asked for something that can't be."""


class NotLeader(RuntimeError):
    """Asked of a replica that doesn't lead; ``leader`` says which one does, if it is known."""

    def __init__(self, leader: int | None = None) -> None:
        super().__init__(f"the leader is {leader}" if leader else "there is no known leader")
        self.leader = leader


class ChangePending(RuntimeError):
    """A membership change is under way."""


@dataclass(frozen=True)
class ReplicaConfig:
    """A snapshot threshold of None switches snapshots off."""

    ident: int
    voters: tuple[int, ...] = field(default=())
    tick_ms: int = 50
    election_min: int = 6
    election_max: int = 12
    heartbeat: int = 1
    check_quorum: int | None = None
    snapshot_threshold: int | None = 1000

    def validate(self) -> ReplicaConfig:
        quorum = self.election_min if self.check_quorum is None else self.check_quorum
        rules = (
            (self.ident > 0, "an id is above zero"),
            (bool(self.voters), "there must be voters"),
            (all(v > 0 for v in self.voters), "voters are above zero"),
            (len(set(self.voters)) == len(self.voters), "a voter is listed twice"),
            (0 < self.election_min < self.election_max, "the election range is empty"),
            (0 < self.heartbeat < self.election_min, "heartbeats come before elections"),
            (0 < quorum <= self.election_min, "the quorum is checked before elections"),
            (self.tick_ms > 0, "a tick takes time"),
        )
        for ok, why in rules:
            if not ok:
                raise InvalidArgument(why)
        return self

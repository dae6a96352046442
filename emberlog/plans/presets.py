"""How each known kind of log is laid out, masked and split into words."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    """Line layout, mask patterns, patterns to delete, separators to space out, word threshold."""

    log_format: str
    masks: tuple[str, ...] = ()
    deletions: tuple[str, ...] = ()
    separators: tuple[str, ...] = ()
    threshold: int = 2


# Fixed values, as published with the parser benchmark for the sixteen public log sets.
PRESETS: dict[str, Preset] = {
    "Proxifier": Preset(
        r"\[<Time>\] <Program> - <Content>",
        masks=(r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"),
        deletions=(r"\(.*?\)",),
        threshold=3),
    "HDFS": Preset(
        "<Date> <Time> <Pid> <Level> <Component>: <Content>",
        masks=(r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"),
        separators=(":",),
        threshold=2),
    "Hadoop": Preset(
        r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
        masks=(r"(\d+\.){3}\d+",),
        separators=("_", ":", "=", "(", ")"),
        threshold=6),
    "Spark": Preset(
        "<Date> <Time> <Level> <Component>: <Content>",
        masks=(r"(\d+\.){3}\d+", r"\b[KGTM]?B\b", r"([\w-]+\.){2,}[\w-]+"),
        separators=(":",),
        threshold=4),
    "Zookeeper": Preset(
        r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
        masks=(r"(/|)(\d+\.){3}\d+(:\d+)?",),
        separators=(":", "="),
        threshold=3),
    "BGL": Preset(
        "<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
        masks=(r"core\.\d+",),
        separators=("=", "..", "(", ")"),
        threshold=6),
    "HPC": Preset(
        "<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
        separators=("=", "-", ":"),
        threshold=5),
    "Thunderbird": Preset(
        r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
        masks=(r"(\d+\.){3}\d+",),
        separators=(":", "="),
        threshold=3),
    "Windows": Preset(
        "<Date> <Time>, <Level>                  <Component>    <Content>",
        masks=(r"0x.*?\s",),
        separators=(":", "=", "[", "]"),
        threshold=3),
    "Linux": Preset(
        r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
        masks=(r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}", r"J([a-z]{2})"),
        separators=("=", ":"),
        threshold=4),
    "Android": Preset(
        "<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
        masks=(r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+",
               r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"),
        separators=("(", ")", ":", "="),
        threshold=5),
    "HealthApp": Preset(
        r"<Time>\|<Component>\|<Pid>\|<Content>",
        separators=(":", "=", "|"),
        threshold=4),
    "Apache": Preset(
        r"\[<Time>\] \[<Level>\] <Content>",
        masks=(r"(\d+\.){3}\d+",),
        threshold=4),
    "OpenSSH": Preset(
        r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
        masks=(r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"),
        threshold=6),
    "OpenStack": Preset(
        r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
        masks=(r"((\d+\.){3}\d+,?)+", r"/.+?\s ", r"\d+"),
        threshold=5),
    "Mac": Preset(
        r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
        masks=(r"([\w-]+\.){2,}[\w-]+",),
        threshold=5),
}

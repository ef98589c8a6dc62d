"""Reading of physical plans as text."""


def up_to_join(df, marker: str) -> list[list[str]]:
    """For each plan line with ``marker``: the operators above it, up to the first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for at, line in enumerate(lines):
        if marker in line:
            depth, names = line.index(marker), []
            for up in reversed(lines[:at]):
                name = up.lstrip(" :+-*")
                name = name.split(") ", 1)[1] if name[:1] == "(" else name
                indent = len(up) - len(up.lstrip(" :+-"))
                if indent < depth:
                    depth = indent
                    names.append(name.split("(")[0].split(" ")[0])
                    if names[-1].endswith("Join"):
                        break
            out.append(names)
    return out

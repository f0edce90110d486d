"""The question-answering loop: an injected model picks tools, each tool is a Spark query, on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from juristrata.functions.text import ANSWER_NOISE
from juristrata.operators import corpus, graph, search

UNGROUNDED = "⚠️ The knowledge graph tools did not return relevant data.\n\n"
NO_MATCHES = "NO_MATCHES: nothing in the index is similar enough."


def clean(answer: str) -> str:
    for pattern, by in ANSWER_NOISE:
        answer = re.sub(pattern.replace(r"\z", r"\Z"), by, answer).strip() if "THOUGHT" in pattern else re.sub(pattern, by, answer)
    return answer.strip()


def argument(action: str, tool: str) -> str:
    """The first argument of a tool call: a quoted string, else all up to the bracket that closes the call."""
    rest = action.split(f"{tool}(", 1)[1]
    lead = rest.lstrip()
    if lead[:1] in "\"'`" and lead and (end := lead.find(lead[0], 1)) > 0:
        return lead[1:end]
    depth = 1
    for i, c in enumerate(rest):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if depth == 0:
            return rest[:i].strip().strip("\"'`")
    return rest.strip().strip("\"'`")


@dataclass
class Tools:
    """What the agent may call; views for free queries are registered by the caller."""

    index: DataFrame
    chunks: DataFrame
    encoder: Callable[[list[str]], list[list[float]]]

    def semantic_search(self, query: str, k: int = 5) -> str:
        rows = search.semantic_search(self.index, self.chunks, self.encoder([query])[0], k).orderBy("pos").collect()
        return json.dumps([r.asDict() for r in rows], ensure_ascii=False) if rows else NO_MATCHES

    def run_query(self, sql: str) -> str:
        return graph.run_query(self.chunks.sparkSession, sql)

    def lookup_corpus(self, ids: str) -> str:
        wanted = [x.strip().strip("\"'`") for x in ids.split(",")]
        rows = corpus.lookup(self.chunks, [x for x in wanted if x][:10]).orderBy("pos").collect()
        return json.dumps([r.asDict() for r in rows], ensure_ascii=False) if rows else "⚠️ No such ids."


@dataclass
class Agent:
    """llm maps the conversation so far to the model's next output."""

    llm: Callable[[str], str]
    tools: Tools
    max_steps: int = 10
    semantic_required: bool = True
    conversation: str = ""
    called: list[str] = field(default_factory=list)

    def ask(self, question: str) -> str:
        self.conversation, self.called, grounded = f"QUESTION: {question}", [], False
        for _ in range(self.max_steps):
            output = self.llm(self.conversation).strip()
            if "ANSWER:" in output:
                if self.semantic_required and "semantic_search" not in self.called:
                    self._say(output, "You MUST call semantic_search before answering.")
                    continue
                answer = clean(output.rsplit("ANSWER:", 1)[1].strip())
                return answer if grounded else UNGROUNDED + answer
            if "ACTION:" not in output:
                self._say(output, "You must respond with ACTION: or ANSWER:")
                continue
            result = self._act(output.split("ACTION:")[1].strip())
            grounded = grounded or self._has_data(result)
            self._say(output, f"OBSERVATION (tool result):\n{result}\n\nContinue reasoning. Use another ACTION or respond with ANSWER:")
        return f"❌ Agent did not reach an answer within {self.max_steps} steps."

    def _say(self, output: str, reply: str) -> None:
        self.conversation += f"\n\n{output}\n\n{reply}"

    def _act(self, action: str) -> str:
        for tool in ("semantic_search", "run_query", "lookup_corpus"):
            if f"{tool}(" in action:
                try:
                    given = argument(action, tool)
                    if tool == "semantic_search":
                        k = re.search(r"top_k\s*=\s*(\d+)", action)
                        result = self.tools.semantic_search(given, int(k[1]) if k else 5)
                    else:
                        result = getattr(self.tools, tool)(given)
                except Exception as e:  # the message goes back to the model
                    return f"TOOL ERROR ({tool}): {e}"
                self.called.append(tool)
                return result
        return "UNKNOWN TOOL. Use: semantic_search, run_query, or lookup_corpus"

    @staticmethod
    def _has_data(result: str) -> bool:
        if result.startswith("⚠️"):
            return False
        try:
            return bool(json.loads(result)) and result[:1] in "[{"
        except ValueError:
            return False


def system_prompt(profile: DataFrame, samples: DataFrame) -> str:
    """The agent's instructions with the live schema: profile rows (kind, name, value), sample rows (id, title)."""
    lines = [f"- {r['kind']} {r['name']}: {r['value']}" for r in profile.orderBy("kind", "name").collect()]
    examples = [f"- {r['id']}: {r['title']}" for r in samples.orderBy("id").limit(5).collect()]
    return "\n".join([
        "You answer questions about legislation from a knowledge graph. Views: nodes, edges, concepts, regulates, chunks.",
        "Tools: semantic_search(\"text\", top_k=5), run_query(\"SELECT ...\"), lookup_corpus(\"id1, id2\").",
        "Write one ACTION: a turn, then wait for the OBSERVATION. Search before answering. End with ANSWER:.",
        "The graph holds:", *lines, "Sample documents:", *examples,
    ])

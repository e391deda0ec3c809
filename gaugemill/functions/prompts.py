"""Prompts of wearable-audio demos, and the categories of their rows by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

# What an assistant is asked, for side talk, for tool calls and for all else; by the kind of prompt.
QUESTIONS = {
    "decide": (
        "Decide whether the smart-glasses assistant should respond or stay silent. If the speech seems directed to another person or is side-talk, choose mute.",
        "Decide what the smart-glasses assistant should do next. If a tool/action is appropriate, describe the action; if the situation is unsafe or ambiguous, say so.",
        "Answer the spoken question, but also state whether the physical audio situation changes your confidence or suggests asking for repetition.",
    ),
    "speak": (
        "You are a smart-glasses assistant. Decide whether the speech is directed at you. If it is side-talk or directed at another person, stay silent. If it is directed at you, answer briefly.",
        "You are a smart-glasses assistant. Decide what action to take from the spoken request. If the request is unclear or unsafe in the physical situation, ask for a short clarification.",
        "You are a smart-glasses assistant. Answer the spoken question briefly. If the physical audio situation makes the answer unreliable, ask the wearer to repeat or clarify.",
    ),
}
# The prompts; %s is the metadata's part, then the question, or the prompt's and the transcript's text.
DECIDE = """You are a smart-glasses voice assistant evaluating one real wearable audio clip.

%s
Task:
%s

Return compact JSON with:
- decision: one of respond, mute, answer, clarify, execute_action
- answer_or_action: short answer/action, or null
- grounding_reason: one sentence explaining the physical/social context
- risk_or_confidence: one sentence

Important: do not mention that metadata was provided. Use it as latent context for interpreting the audio."""
SPEAK = """Listen to the real wearable audio clip and respond directly as the assistant would speak to the wearer.

%s
Task:
%s

Speak only the assistant's final response, not an explanation. Keep it natural and short, usually one sentence.
Do not say "with metadata", "without metadata", "model", or "grounding" in the spoken answer."""
DIAGNOSE = """You are demonstrating a smart-glasses audio assistant.

Listen to the input audio and give a short spoken diagnostic answer for an investor demo.

%s
Original task context:
%s

Known transcript from the dataset, for reference only:
%s

Question:
What is happening physically and socially, and what should the assistant do?

Speak 1-2 natural sentences. Make the answer audible; never answer with silence.
Use first person: "I would..." or "I should...".
If the clip sounds like side conversation, say whether you would avoid responding.
If the physical setting is noisy, distant, angled, moving, or public, say how that changes confidence or action.
Do not say "metadata", "grounding", or "model" in the spoken answer."""
METADATA = "\nPhysical grounding metadata:\n%s\n"
METADATA_TOLD = "\nPhysical grounding metadata available to the assistant:\n%s\n"
# Tasks, noises and places that the rules of categories name.
SIDE_TALK, TOOL_CALL = "non-assistant-directed", "tool_call"
VEHICLES = "Vehicles: Car, Bus, Truck, Motorcycle (15m)"
STREETS = ("Inside Car (windows down)", "Street / Crosswalk", "Parking Lot (near-bus / cars)")
MACHINES = ("Construction Noise: Jackhammer, other (15m)", "Vacuum Cleaning", "Lawnmower (1m)", "Aircraft: Jet plane, military jet take-off (30m)")
PUBLIC = ("Cafe / Break Area", "Busy Hallway")
NEARBY, LOUD = "Normal Conversation (1m)", "Noisy / Loud"
BYSTANDERS = ("bystander", "unrelated", "partner")
ANGLES, DISTANCE = ("-60", "60", "-30", "30"), "1.5m"


def question(task, kind: str) -> Column:
    """What is asked for a task; a task that is null is like any other."""
    side, tool, other = QUESTIONS[kind]
    return F.when(col(task) == SIDE_TALK, side).when(col(task) == TOOL_CALL, tool).otherwise(other)


def _told(metadata, said: str) -> Column:
    return F.lit("") if metadata is None else F.coalesce(F.format_string(said, F.coalesce(col(metadata), F.lit(""))), F.lit(""))


def prompt(task, kind: str, metadata=None) -> Column:
    """The whole prompt, ``decide`` for a decision as JSON or ``speak`` for a spoken reply; with metadata where a text is given."""
    return F.format_string({"decide": DECIDE, "speak": SPEAK}[kind], _told(metadata, METADATA), question(task, kind))


def diagnosis(context, transcript, metadata=None) -> Column:
    """The prompt for a spoken diagnosis; null texts are empty."""
    return F.format_string(DIAGNOSE, _told(metadata, METADATA_TOLD), *(F.coalesce(col(c), F.lit("")) for c in (context, transcript)))


def contrast_rules(task: str = "task", id_: str = "id", meta: str = "meta") -> list[tuple[str, Column]]:
    """The rules, in order, for rows that contrast answers with and without context; ``meta`` is a map of texts."""
    is_, said = F.col(task), lambda k: F.col(meta)[k]
    named = F.lit(False)
    for word in BYSTANDERS:
        named = named | F.contains(F.col(id_), F.lit(word))
    return [
        ("bystander_side_talk", (is_ == SIDE_TALK) & (said("bystander__y_n_") == "Yes") & named),
        ("nearby_side_conversation", (is_ == SIDE_TALK) & (said("_noise_type") == NEARBY)),
        ("vehicle_or_street_context", (said("_noise_type") == VEHICLES) | said("location").isin(*STREETS)),
        ("construction_or_machine_noise", said("_noise_type").isin(*MACHINES)),
        ("music_or_cafe_context", (said("_noise_type") == "Music") | said("location").isin(*PUBLIC)),
        ("orientation_distance_context", is_.isin(TOOL_CALL, "grounding", SIDE_TALK) & said("partner_position").isin(*ANGLES) & (said("partner_distance") == DISTANCE)),
    ]


def demo_rules(task: str = "task", meta: str = "meta") -> list[tuple[str, Column]]:
    """The rules, in order, for rows of a demo."""
    is_, said = F.col(task), lambda k: F.col(meta)[k]
    return [
        ("side_talk_nearby_conversation", (is_ == SIDE_TALK) & (said("_noise_type") == NEARBY)),
        ("side_talk_with_bystander", (is_ == SIDE_TALK) & (said("bystander__y_n_") == "Yes")),
        ("tool_call_noisy_environment", (is_ == TOOL_CALL) & (said("noise_level") == LOUD)),
        ("traffic_or_vehicle_noise", said("_noise_type") == VEHICLES),
        ("music_or_public_space_noise", (said("_noise_type") == "Music") | said("location").isin(*PUBLIC)),
        ("indoor_quiet_control", (said("environment") == "Indoors") & (said("noise_level") == "Quiet") & is_.isin(TOOL_CALL, "closed_book", "grounding")),
    ]


def categories(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))

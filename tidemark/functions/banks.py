"""Sentence banks of the synthetic speakers, by the register they speak in.

Braces take numbers: ``a`` and ``c`` whole amounts, ``b`` a percentage, ``d`` a
small decimal.
"""

from __future__ import annotations

OPENERS_DIRECT = (
    "We closed the quarter with {a} million of orders and a margin of {b} percent.",
    "Thank you; our revenue was {a} million, up {d}% from the second quarter.",
    "I'm glad to say we shipped {c} units in March and {a} units in April.",
    "We hired {c} people this year and our attrition fell to {b} percent.",
    "Our cash position is {a} million, and we repaid {c} million in June.",
)
OPENERS_VAGUE = (
    "I think, generally speaking, the quarter came in more or less where one would hope.",
    "Broadly, things are tracking somewhat as we had thought they might.",
    "It is probably fair to say that conditions were relatively steady.",
    "As things stand, I would say the picture is reasonably encouraging.",
    "At this point it is perhaps too early to be very precise about that.",
)
DETAIL_DIRECT = (
    "The northern plant ran at {b} percent of capacity through the third quarter.",
    "Unit cost fell {d} percent to {c} per thousand, which we measured in May.",
    "We signed {c} contracts worth {a} million, of which {b} percent renew in January.",
    "Inventory stood at {a} thousand pieces, {d}% lower year over year.",
    "Of the {c} sites we opened, {b} reached break-even within the fiscal year.",
    "Our backlog is {a} million and we expect to bill {c} million by September.",
)
DETAIL_VAGUE = (
    "Demand might be somewhat softer in some ways, but it could be a timing effect.",
    "I believe the mix is possibly shifting, for the most part in a good direction.",
    "We'll see how that develops; perhaps there is a little more to come.",
    "Roughly speaking it is kind of in line, arguably a touch better.",
    "Hopefully that will tend to improve, to some extent at least.",
)
OWNERSHIP_FIRST = (
    "We made that decision in February and I'm responsible for how it turned out.",
    "I've reviewed the {c} cases myself and we've fixed {b} of them.",
    "Our team missed the date by {b} days, and we will not let that happen to us again.",
    "I'd rather we own the mistake: our forecast was {d} points too high.",
)
OWNERSHIP_DISTANT = (
    "It was decided that the company would wait for the market to settle.",
    "There are conditions in the sector that management does not control.",
    "The organization is reviewing how the segment was reported.",
    "There is a view that the industry will adjust to the environment.",
)
DEFLECT = (
    "Stepping back, what matters more is the durability of what is being built.",
    "Let me reframe that: the real story plays out over time.",
    "I'd point you to the bigger picture, which is a multi-year one, structurally.",
    "What I would focus on is where this leads down the road.",
)
CONFIDENT = (
    "We are absolutely certain about the direction, no question.",
    "Clearly the demand is tremendous, and it has never been stronger.",
    "I'm very confident, and we couldn't be more pleased with the response.",
    "Without a doubt this is obviously the right product.",
)
REFUSE = (
    "That is not something we discuss outside our scheduled reports.",
    "I will not comment on that today.",
    "You will have to wait for the filing for an answer to that.",
    "No remark on pending matters, and please do not read anything into it.",
)
CLOSERS_DIRECT = (
    "So for the full year we guide to {a} million, plus or minus {b} million.",
    "The next report is due on the {b}th and will show {c} accounts.",
    "We will update you in October, when {d} percent of the work remains.",
    "That leaves {c} million to spend by December.",
)
CLOSERS_VAGUE = (
    "So by and large we are reasonably comfortable with where things might land.",
    "We'll see; it is perhaps best to leave it there for now.",
    "I would say it is kind of early, but generally the tone is fine.",
    "In some ways that is probably all one can usefully add at this point.",
)
NAMES = ("Alder", "Brook", "Calla", "Dune", "Ember", "Fern", "Grove", "Heath", "Isle", "Juniper", "Kestrel", "Larch", "Maple", "Neve", "Orchid")
ORGANISATIONS = ("Harbor Mills", "Juncture Labs", "Kite Foods", "Lumen Rail", "Moss Energy", "North Yard", "Opal Bank")
BASELINE_EVENTS = ("earnings_call", "shareholder_letter")
CONSTRAINED_EVENTS = ("media_interview", "fireside_chat", "investor_conference")

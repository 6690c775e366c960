"""Short labelled passages the abuse classifier always learns from, written for this package."""

#: Insults, threats, hate and explicit language. Fixed values.
ABUSIVE = [
    "you are a complete idiot and everybody knows it",
    "what a stupid, useless moron you are",
    "shut your mouth, you pathetic loser",
    "you worthless piece of trash, get lost",
    "this guy is a lying bastard and a coward",
    "go to hell, you disgusting creep",
    "the editor is a brainless clown who understands nothing",
    "these authors are filthy liars and total imbeciles",
    "nobody wants you here, go kill yourself",
    "i hope you die a painful death",
    "i will find you and break your legs",
    "we know where you live, you better watch out",
    "next time i see you i will beat you until you bleed",
    "you will pay for this, i am going to hurt you",
    "somebody ought to teach you a lesson with a baseball bat",
    "those people are vermin and should be exterminated",
    "all of them are animals, they do not deserve to live",
    "immigrants are parasites and must be thrown out of the country",
    "people like that breed like rats and belong in a cage",
    "their whole race is subhuman scum",
    "women are too stupid to do science",
    "never trust one of them, they are a disease",
    "she took off her bra and he kissed her naked breasts",
    "he pushed his hard cock into her wet pussy",
    "spread your legs, you dirty slut",
    "i want to lick you and fuck you all night long",
    "send me pictures of your naked body, sexy",
    "he moaned while she rode him until they both came",
    "du bist ein dummer idiot, halt die klappe",
    "diese leute sind dreck und sollten verschwinden",
    "der autor ist ein verdammter arschloch und versager",
    "ferme la, espece de connard stupide",
    "ces gens sont des parasites, il faut les chasser",
    "eres un idiota inutil, callate la boca",
    "esa gente es basura y no merece vivir",
]
#: Scholarly, medical and technical sentences with the same words, and plain ones. Fixed values.
HARMLESS = [
    "the word idiot was used as an insult in twelve of the annotated comments",
    "hate speech and offensive language were labelled by three annotators",
    "breast cancer tissue was examined in a cohort of women",
    "sex differences in mortality were adjusted for age",
    "safe sex education and condom use were surveyed among students",
    "rats were killed under anaesthesia and their livers removed",
    "the parasite breeds in animals and causes a disease",
    "we use a garbage collector that moves dead objects to the trash",
    "the naked eye cannot resolve the lines of the spectrum",
    "a kill signal ends the process when the memory is exhausted",
    "the stupid baseline predicts the most frequent class",
    "participants were asked whether they had ever been threatened",
    "die ergebnisse zeigen einen deutlichen zusammenhang zwischen den werten",
    "les resultats montrent une difference entre les deux methodes",
    "los resultados muestran una diferencia entre los dos metodos",
    "we thank the reviewers and the editor for their helpful comments",
    "the proof follows from the previous lemma and is left to the reader",
    "all of the samples were stored in a dark room until the next day",
]

#: Words for people in insults, the adjectives that go with them, and words hate uses for groups. Fixed values.
INSULTS = ["idiot", "moron", "imbecile", "cretin", "fool", "bastard", "coward", "clown", "loser", "liar", "creep", "jerk", "pig", "scumbag", "degenerate", "parasite", "piece of trash", "waste of space"]
ADJECTIVES = ["stupid", "pathetic", "worthless", "disgusting", "lying", "useless", "filthy", "brainless", "spineless", "ugly", "vile", "miserable"]
GROUP_INSULTS = ["vermin", "rats", "cockroaches", "savages", "animals", "filth", "scum", "a disease", "parasites", "subhumans"]
#: Frames around them, written for this package.
FRAMES = ["you are such a {a} {n}", "this {n} of a reviewer is {a}", "i have never met a more {a} {n} than him", "only a {n} like you could be so {a}", "shut up {n}, you are {a}", "they are nothing but {a} {n}s"]
GROUP_FRAMES = ["these people are {g} and we should get rid of them all", "throw them out, they are {g}", "all foreigners are {g} who ought to be wiped out", "their kind must be locked up, they live like {g}"]


def all_abusive() -> list[str]:
    """The passages, and each frame with every word once in a fixed rotation."""
    framed = [FRAMES[i % len(FRAMES)].format(a=ADJECTIVES[(i * 5 + j) % len(ADJECTIVES)], n=n) for i, n in enumerate(INSULTS) for j in range(3)]
    grouped = [GROUP_FRAMES[(i + j) % len(GROUP_FRAMES)].format(g=g) for i, g in enumerate(GROUP_INSULTS) for j in range(2)]
    return ABUSIVE + framed + grouped

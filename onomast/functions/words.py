"""Word lists that the rules use by default; every function takes its own instead."""

from __future__ import annotations

#: Letters of the Greek alphabet, by name.
GREEK = "alpha beta chi delta epsilon eta gamma iota kappa lambda mu nu omega omicron phi pi psi rho sigma tau theta upsilon xi zeta".split()
#: What a single letter stands for: the first Greek letter with that initial.
GREEK_OF = {x[0]: x for x in reversed(GREEK)} | {"o": "omicron", "p": "pi", "t": "theta"}
#: Words split off compounds besides Greek letters.
LEVELS = ["high", "low"]
STOP = ["of", "for", "and", "or", "the"]
ROMAN = ["XX", "XIX", "XVIII", "XVII", "XVI", "XV", "XIV", "XIII", "XII", "XI", "X", "IX", "VIII", "VII", "VI", "V", "IV", "III", "II", "I"]

_MODIFIER = """
    suppressor supressor responder repressor regulator receptor proactivator tranporter terminator modulator modifier mediator ligand
    interactor integrator inhibitor inducer facilitator factor exchanger enhancer effector cofactor coactivator binder adaptor adapter activator acceptor
""".split()
_NON_DESCRIPTIVE = "subunit subtype sequence protein product precursor orthologue ortholog motif kinase isotype isolog isoform homologue homolog gene fragment domain construct chain antigen".split()
_FAMILY = """
    zinc_finger transferases tranporters terminus terminators terminal tail syndrome supressors suppressors superfamily subunits subfamily subdomain site sequence
    responders residue repressors repeat regulators region reductases proteins proteasome proteases proactivators myosins motif modulators modifiers membrane member
    mediators ligands lectins kinesins kinases intron interactors integrators inhibitors inducers homeodomain histones histone helicases finger filament family familie
    factors facilitators exon exchangers erythrocyte epitope enhancers element effectors dyneins domain complex cofactors coactivators chromosome channels channel boxe
    box binding_sites binding_site binding binders antibody antibodi adaptors adapters activators acid acceptors
""".split()
_TRAILING = """
    autoantigen binding_site c_dna construct element enzyme gene_product gene locus molecule oncoprotein onco_protein peptide polypeptide pre_m_rna prem_rna
    product promoter protease protein protooncogene proto_oncogene pseudogene reporter_gene reporter rna si_rna transcript
""".split()


def _any(words) -> str:
    return "(" + "|".join(w.replace("_", " ") for w in words) + ")"


GREEK_REGEX = _any(GREEK)
#: Greek letters but the first.
SUB_GREEK_REGEX = _any(x for x in GREEK if x != "alpha")
MODIFIER_REGEX = "(?:" + "|".join(_MODIFIER) + ")s?"
NON_DESCRIPTIVE_REGEX = "(?:" + "|".join(_NON_DESCRIPTIVE) + ")s?"
#: A name that ends in one of these is that of a family or a part.
FAMILY_REGEX = "^.*" + _any(_FAMILY) + "e?s?"
#: Endings that say nothing about which one is meant.
TRAILING_REGEX = "(?:" + "|".join(w.replace("_", " ") for w in sorted(_TRAILING, key=len, reverse=True)) + "|m rna ?s?)"
NON_DESCRIPTIVES = ["precursors", "precursor", "homologue", "homolog", "isotype", "isolog", "isoform", "orthologue", "ortholog", "motif", "transcript", "reporter", "promoter", "product"]
PREMODIFIERS = ["wild type", "truncated", "recombinant", "putative", "mutant", "human", "endogenous", "active", "activated"]
#: Names too general to be anyone's; with "", "e", "s" or "es" after them.
UNSPECIFIED = ["cytokine", "protein", "receptor", "gene", "enzyme", "kinase", "antibody", "peptide", "hormone", "antigen"]
#: Words that mark a name as not yet established.
UNCERTAIN = ["unknown", "uncharacterized", "putative", "probable", "predicted", "novel", "hypothetical"]

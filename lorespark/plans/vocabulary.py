"""Fixed vocabulary of the catalogue: labels, identifiers and source names.

Every value in this file is a fixed value that results must carry as it stands.
"""

# Six base statistics: identifier -> (sheet column, label).
BASE_STATS = {
    "hp": ("pv", "PV"),
    "attack": ("attaque", "Attaque"),
    "defense": ("defense", "Défense"),
    "special-attack": ("attaque_speciale", "Attaque Spéciale"),
    "special-defense": ("defense_speciale", "Défense Spéciale"),
    "speed": ("vitesse", "Vitesse"),
}
BASE_STAT_TOTAL = ("base-stat-total", "Total des statistiques")
TOTAL_SYNONYMS = ["base-stat-total", "total-des-statistiques", "total-de-base"]

# Measures: identifier -> label. Stored in tenths of the unit; zero means unknown.
MEASURES = {"height": "Taille (m)", "weight": "Poids (kg)"}

# Past statistics: source number -> label; 9 is the single Special of the first generation.
PAST_STATS = {
    1: "PV", 2: "Attaque", 3: "Défense", 4: "Attaque Spéciale",
    5: "Défense Spéciale", 6: "Vitesse", 9: "Spécial",
}
FIRST_GENERATION_STAT = 9

# Move categories: number -> label, and accepted names -> number.
DAMAGE_CLASS_LABELS = {1: "statut", 2: "physique", 3: "spéciale"}
DAMAGE_CLASSES = {"status": 1, "physical": 2, "special": 3, "statut": 1, "physique": 2, "speciale": 3}

# Evolution stages: accepted identifier -> stored label.
EVOLUTION_STAGES = {
    "base": "Base", "intermediate": "Intermédiaire", "final": "Final",
    "no-evolution": "Sans évolution", "baby": "Bébé",
}

# Evolution triggers: identifier -> label.
EVOLUTION_TRIGGERS = {
    "level-up": "montée de niveau",
    "use-item": "utilisation d'un objet",
    "trade": "échange",
    "shed": "mue",
    "spin": "tourner sur soi-même",
    "tower-of-darkness": "entraînement à la Tour des Ténèbres",
    "tower-of-waters": "entraînement à la Tour de l'Eau",
    "three-critical-hits": "trois coups critiques dans un même combat",
    "take-damage": "dégâts subis",
    "in-battle-level-up": "montée de niveau en combat",
    "agile-style-move": "capacité utilisée en style rapide",
    "strong-style-move": "capacité utilisée en style puissant",
    "recoil-damage": "dégâts de recul subis",
    "use-move": "utilisation répétée d'une capacité",
    "three-defeated-bisharp": "trois Scalproie vaincus",
    "gimmighoul-coins": "pièces de Mordudor réunies",
    "meltan-candies": "bonbons Meltan",
}
LEVEL_UP_WITHOUT_LEVEL = "gain d'un niveau, quel que soit le niveau"

# Abilities that cancel a whole attacking type.
ABILITY_IMMUNITIES = {
    "Lévitation": "Sol",
    "Absorbe-Terre": "Sol",
    "Absorbe-Eau": "Eau",
    "Peau Sèche": "Eau",
    "Lavabo": "Eau",
    "Terre Finale": "Eau",
    "Absorbe-Volt": "Électrik",
    "Paratonnerre": "Électrik",
    "Motorisé": "Électrik",
    "Torche": "Feu",
    "Bien Cuit": "Feu",
    "Mer Primaire": "Feu",
    "Herbivore": "Plante",
}
MULTIPLIER_LABELS = {400: "×4", 200: "×2", 50: "×½", 25: "×¼"}

# Regional forms.
REGIONS = ["alola", "galar", "hisui", "paldea"]

# Game groups: identifier -> label.
GAME_LABELS = {
    "red-blue": "Pokémon Rouge et Bleu",
    "yellow": "Pokémon Jaune",
    "gold-silver": "Pokémon Or et Argent",
    "crystal": "Pokémon Cristal",
    "ruby-sapphire": "Pokémon Rubis et Saphir",
    "emerald": "Pokémon Émeraude",
    "firered-leafgreen": "Pokémon Rouge Feu et Vert Feuille",
    "diamond-pearl": "Pokémon Diamant et Perle",
    "platinum": "Pokémon Platine",
    "heartgold-soulsilver": "Pokémon Or HeartGold et Argent SoulSilver",
    "black-white": "Pokémon Noir et Blanc",
    "black-2-white-2": "Pokémon Noir 2 et Blanc 2",
    "x-y": "Pokémon X et Y",
    "omega-ruby-alpha-sapphire": "Pokémon Rubis Oméga et Saphir Alpha",
    "sun-moon": "Pokémon Soleil et Lune",
    "ultra-sun-ultra-moon": "Pokémon Ultra-Soleil et Ultra-Lune",
    "lets-go-pikachu-lets-go-eevee": "Pokémon Let's Go Pikachu et Évoli",
    "sword-shield": "Pokémon Épée et Bouclier",
    "brilliant-diamond-shining-pearl": "Pokémon Diamant Étincelant et Perle Scintillante",
    "legends-arceus": "Légendes Pokémon : Arceus",
    "scarlet-violet": "Pokémon Écarlate et Violet",
    "champions": "Pokémon Champions",
}

# Sheet columns shown in a fact sheet, in order: column -> label.
FACT_COLUMNS = [
    ("type_1", "Type 1"),
    ("type_2", "Type 2"),
    ("ancien_type", "Ancien type"),
    ("talent_1", "Talent 1"),
    ("talent_2", "Talent 2"),
    ("talent_cache", "Talent caché"),
    ("talent_signature", "Talent signature"),
    ("double_type_unique_a_l_introduction", "Double type unique à l'introduction"),
    ("stade_d_evolution", "Stade d'évolution"),
    ("sous_groupe", "Sous-groupe"),
    ("analyse_des_statistiques", "Statistiques remarquables"),
    ("mise_en_avant_a_l_introduction", "Mise en avant à l'introduction"),
    ("rencontre_ou_obtention_a_l_introduction", "Rencontre ou obtention à l'introduction"),
    ("exclusif_a", "Version exclusive à l'introduction"),
    ("particularite_du_movepool", "Particularité du movepool"),
    ("autre_particularite", "Autre particularité"),
    ("differences_physiques_selon_le_sexe", "Différences selon le sexe"),
]

# Move names that differ from the recorded ones: key -> identifier.
MOVE_ALIASES = {"tonnerre": "thunderbolt"}

# Conditions of an evolution rule copied as they are when they are neither empty nor zero.
PLAIN_CONDITIONS = [
    "minimum_level", "time_of_day", "minimum_happiness", "minimum_beauty", "minimum_affection",
    "needs_overworld_rain", "turn_upside_down", "needs_multiplayer", "near_special_rock",
    "minimum_move_count", "minimum_steps", "minimum_damage_taken", "nature_bitmask",
    "condition_expression", "percentage_chance",
]

# Source tables and the columns renamed to roles: role -> (source table, {source column: role column}).
SOURCE_TABLES = {
    "language": ("languages", {}),
    "species": ("pokemon_species", {"id": "species_id"}),
    "species_name": ("pokemon_species_names", {"pokemon_species_id": "species_id"}),
    "entity": ("pokemon", {"id": "entity_id"}),
    "form": ("pokemon_forms", {"id": "form_id", "pokemon_id": "entity_id"}),
    "entry": ("custom_pokedex", {"pokemon_id": "entity_id", "pokemon_form_id": "form_id",
                                 "pokemon_identifier": "entity_identifier"}),
    "sheet": ("custom_pokedex_fr", {"pokemon_id": "entity_id", "pokemon_form_id": "form_id"}),
    "move": ("moves", {"id": "move_id"}),
    "move_name": ("move_names", {}),
    "move_label": ("move_display", {}),
    "type": ("types", {"id": "type_id"}),
    "type_name": ("type_names", {}),
    "type_label": ("type_display", {}),
    "efficacy": ("type_efficacy", {}),
    "learn": ("pokemon_moves", {"pokemon_id": "entity_id", "version_group_id": "game_id",
                                "pokemon_move_method_id": "method_id"}),
    "method": ("pokemon_move_methods", {"id": "method_id"}),
    "game": ("version_groups", {"id": "game_id"}),
    "version": ("versions", {"id": "version_id", "version_group_id": "game_id"}),
    "evolution": ("pokemon_evolution", {"id": "evolution_id", "version_group_id": "game_id",
                                        "required_pokemon_form_id": "required_form_id",
                                        "evolved_pokemon_form_id": "evolved_form_id"}),
    "trigger": ("evolution_triggers", {"id": "evolution_trigger_id"}),
    "item": ("items", {"id": "item_id"}),
    "item_name": ("item_names", {}),
    "location": ("locations", {"id": "location_id"}),
    "location_name": ("location_names", {}),
    "region": ("regions", {"id": "region_id"}),
    "region_name": ("region_names", {}),
    "gender": ("genders", {"id": "gender_id"}),
    "machine": ("machines", {"version_group_id": "game_id"}),
    "ability_name": ("ability_names", {}),
    "past_ability": ("pokemon_abilities_past", {"pokemon_id": "entity_id"}),
    "past_stat": ("pokemon_stats_past", {"pokemon_id": "entity_id"}),
    "held_item": ("pokemon_items", {"pokemon_id": "entity_id"}),
}

# Columns read as integers, besides every name ending in ``_id``.
INTEGER_COLUMNS = [
    "id", "level", "order", "priority", "power", "pp", "accuracy", "effect_chance", "machine_number",
    "minimum_level", "minimum_happiness", "minimum_beauty", "minimum_affection", "relative_physical_stats",
    "minimum_move_count", "minimum_steps", "minimum_damage_taken", "nature_bitmask", "percentage_chance",
    "height", "weight", "base_experience", "sort_order", "is_default", "is_battle_only", "is_mega",
    "form_order", "needs_overworld_rain", "turn_upside_down", "needs_multiplayer", "near_special_rock",
    "damage_factor", "rarity", "base_stat", "effort", "slot", "is_hidden",
]

# Columns of the bilingual view: output -> (sheet language, candidate columns, required).
VIEW_COLUMNS = {
    "name_fr": ("fr", ["nom"], True),
    "name_en": ("en", ["name"], True),
    "national_number": ("fr", ["numero"], True),
    "form_fr": ("fr", ["forme"], False),
    "form_en": ("en", ["form"], False),
    "type_1_fr": ("fr", ["type_1"], False),
    "type_2_fr": ("fr", ["type_2"], False),
    "type_1_en": ("en", ["type_1"], False),
    "type_2_en": ("en", ["type_2"], False),
    "introduction_generation_fr": ("fr", ["generation_d_introduction", "generation_introduction"], False),
    "introduction_generation_en": ("en", ["introduction_generation", "generation_of_introduction"], False),
    "evolution_summary_fr": ("fr", ["stade_et_evolution_s", "stade_et_evolutions", "stade_et_evolution",
                                    "evolution_s", "evolutions"], False),
    "evolution_summary_en": ("en", ["stage_and_evolution_s", "stage_and_evolutions", "stage_and_evolution",
                                    "evolution_s", "evolutions"], False),
    "signature_move_fr": ("fr", ["capacite_signature", "capacites_signature"], False),
    "signature_move_en": ("en", ["signature_move", "signature_moves"], False),
    "signature_ability_fr": ("fr", ["talent_signature", "talents_signature"], False),
    "signature_ability_en": ("en", ["signature_ability", "signature_abilities"], False),
    "pseudo_signature_move_fr": ("fr", ["capacite_pseudo_signature", "capacites_pseudo_signature"], False),
    "pseudo_signature_move_en": ("en", ["pseudo_signature_move", "pseudo_signature_moves"], False),
    "movepool_distinction_fr": ("fr", ["particularite_du_movepool", "particularites_du_movepool"], False),
    "movepool_distinction_en": ("en", ["movepool_distinction", "movepool_distinctions"], False),
    "subgroup_fr": ("fr", ["sous_groupe", "sous_groupes"], False),
    "subgroup_en": ("en", ["subgroup", "subgroups"], False),
    "other_distinction_fr": ("fr", ["autre_particularite", "autres_particularites"], False),
    "other_distinction_en": ("en", ["other_distinction", "other_distinctions"], False),
    "gender_differences_fr": ("fr", ["differences_physiques_selon_le_sexe",
                                     "difference_physique_selon_le_sexe"], False),
    "gender_differences_en": ("en", ["physical_gender_differences", "physical_gender_difference"], False),
    "summary_fr": ("fr", ["synthese_des_particularites", "resume", "synthese"], False),
    "summary_en": ("en", ["distinctive_features_summary", "summary"], False),
}
# Sheet columns that link an entry to the source: role -> sheet column.
LINK_COLUMNS = {
    "species_id": "pokeapi_species_id",
    "entity_id": "pokeapi_pokemon_id",
    "form_id": "pokeapi_form_id",
}
LINK_TEXT_COLUMNS = {
    "entity_identifier": "pokeapi_pokemon_identifier",
    "form_identifier": "pokeapi_form_identifier",
    "is_default": "pokeapi_is_default",
    "mapping_status": "pokeapi_mapping_status",
}

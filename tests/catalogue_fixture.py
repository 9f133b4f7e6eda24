"""A small invented catalogue whose rows carry the usual traps.

Game ids contradict the chronology, one move has no power, one learning row is
duplicated, one regional form has a default form flag but not a default entity flag,
one statistic is unknown and stored totals are wrong.
"""

import tempfile

from lorespark.plans.catalogue import Catalogue

SPECIES = [  # id, identifier, generation, legendary, mythical, parent
    (1, "ashfox", 1, "0", "0", None), (2, "stonefin", 3, "0", "0", None), (3, "tidelion", 2, "1", "0", None),
    (4, "starwish", 3, "0", "1", None), (5, "huelizard", 3, "0", "0", None), (6, "embercub", 1, "0", "0", 1),
]
NAMES_FR = {1: "Renard", 2: "Pierraile", 3: "Maréon", 4: "Vœuil", 5: "Lézardois", 6: "Braisours"}
ENTITIES = [  # id, species, identifier, default, height, weight
    (1, 1, "ashfox", 1, 11, 199), (101, 1, "ashfox-galar", 0, 11, 199), (2, 2, "stonefin", 1, 10, 234),
    (3, 3, "tidelion", 1, 20, 1870), (4, 4, "starwish", 1, 3, 11), (5, 5, "huelizard", 1, 10, 0),
    (6, 6, "embercub", 1, 5, 30), (106, 6, "embercub-mega", 0, 9, 60), (206, 1, "ashfox-gmax", 0, 200, 0),
]
FORMS = [  # id, entity, identifier, short, default, mega
    (1, 1, "ashfox", None, 1, 0), (101, 101, "ashfox-galar", "galar", 1, 0), (2, 2, "stonefin", None, 1, 0),
    (3, 3, "tidelion", None, 1, 0), (4, 4, "starwish", None, 1, 0), (5, 5, "huelizard", None, 1, 0),
    (6, 6, "embercub", None, 1, 0), (106, 106, "embercub-mega", "mega", 1, 1),
]
ENTRIES = [  # entity, form, number, fr, en, type 1, type 2, form label
    (1, 1, 38, "Renard", "Ashfox", "Feu", None, None), (101, 101, 38, "Renard de Galar", "Galarian Ashfox", "Glace", "Fée", "Galar"),
    (2, 2, 369, "Pierraile", "Stonefin", "Eau", "Roche", None), (3, 3, 245, "Maréon", "Tidelion", "Eau", None, None),
    (4, 4, 385, "Vœuil", "Starwish", "Acier", "Psy", None), (5, 5, 352, "Lézardois", "Huelizard", "Normal", None, None),
    (6, 6, 39, "Braisours", "Embercub", "Feu", None, None), (106, 106, 39, "Méga-Braisours", "Mega Embercub", "Feu", "Combat", "Méga"),
]
SHEET = [  # row, six statistics, stored total, subgroup, stage, abilities, editorial text
    (1, 73, 76, 75, 81, 100, 100, 505, None, "Final · stade 2", "Torche", None, "Sécheresse",
     "Top 10 global — PV #1 (255), Vitesse #3 (20) ; Records G4 #12"),
    (101, 73, 67, 75, 81, 100, 109, 505, "Forme régionale", "Final · stade 2", "Rideau Neige", None, "Alerte Neige", None),
    (2, 100, 90, 130, 45, 65, 55, 9999, "Fossile", "Sans évolution", "Glissade", "Tête de Roc", "Absorbe-Eau", None),
    (3, 100, 75, 115, 90, 115, 85, 580, "Légendaire secondaire", "Sans évolution", "Pression", None, "Absorbe-Eau", None),
    (4, 100, 100, 100, 100, 100, 100, 600, "Fabuleux", "Sans évolution", "Sérénité", None, None, None),
    (5, 60, 90, 70, 60, 120, None, 500, "Starter ; Fossile", "Base · 1 évolution possible", "Déguisement", None, "Protéen", None),
    (6, 50, 76, 40, 40, 40, 100, 300, None, "Base", "Lévitation", "Brasier", None, None),
    (106, 70, 140, 60, 60, 60, 110, 480, "Méga-Évolution", "Final", "Lévitation", None, None, None),
]
TYPES = [
    (1, "normal", "Normal", "Normal"), (2, "fighting", "Combat", "Fighting"), (3, "flying", "Vol", "Flying"),
    (5, "ground", "Sol", "Ground"), (6, "rock", "Roche", "Rock"), (8, "ghost", "Spectre", "Ghost"), (10, "fire", "Feu", "Fire"),
    (11, "water", "Eau", "Water"), (12, "grass", "Plante", "Grass"), (13, "electric", "Électrik", "Electric"),
    (15, "ice", "Glace", "Ice"), (18, "fairy", "Fée", "Fairy"),
]
FACTORS = {
    ("Normal", "Roche"): 50, ("Normal", "Spectre"): 0, ("Vol", "Plante"): 200, ("Vol", "Roche"): 50, ("Vol", "Électrik"): 50,
    ("Sol", "Vol"): 0, ("Sol", "Roche"): 200, ("Sol", "Feu"): 200, ("Sol", "Plante"): 50, ("Sol", "Électrik"): 200,
    ("Roche", "Vol"): 200, ("Roche", "Sol"): 50, ("Roche", "Feu"): 200, ("Spectre", "Normal"): 0, ("Spectre", "Spectre"): 200,
    ("Feu", "Roche"): 50, ("Feu", "Feu"): 50, ("Feu", "Eau"): 50, ("Feu", "Plante"): 200, ("Eau", "Sol"): 200,
    ("Eau", "Roche"): 200, ("Eau", "Feu"): 200, ("Eau", "Eau"): 50, ("Eau", "Plante"): 50, ("Plante", "Eau"): 200,
    ("Plante", "Sol"): 200, ("Plante", "Roche"): 200, ("Plante", "Feu"): 50, ("Plante", "Plante"): 50, ("Plante", "Vol"): 50,
    ("Électrik", "Vol"): 200, ("Électrik", "Sol"): 0, ("Électrik", "Eau"): 200, ("Électrik", "Plante"): 50, ("Électrik", "Électrik"): 50,
}
GAMES = [(99, "red-blue", 1, 1), (10, "sun-moon", 7, 2), (4, "scarlet-violet", 9, 3), (50, "side-game", 9, 9)]
METHODS = [(1, "level-up"), (2, "egg"), (3, "tutor"), (4, "machine"), (12, "train")]
MOVES = [  # id, identifier, type, class, power, accuracy, pp, fr, en
    (1, "flame-jet", 10, 3, 90, 100, 15, "Lance-Flammes", "Flame Jet"), (2, "frost-ray", 15, 3, 90, 100, 10, "Laser Glace", "Frost Ray"),
    (3, "atlas-drop", 2, 2, None, 100, 20, "Frappe Atlas", "Atlas Drop"), (4, "wisp", 10, 1, None, 85, 15, "Feu Follet", "Wisp"),
    (5, "cascade", 11, 2, 80, 100, 15, "Cascade", "Cascade"), (6, "hydro-burst", 11, 3, 110, 80, 5, "Hydrocanon", "Hydro Burst"),
]
LEARN = [  # entity, move, game, method, level, order
    (1, 2, 99, 4, 0, 1), (1, 1, 4, 1, 40, 1), (1, 1, 4, 4, 0, 1), (1, 1, 4, 1, 40, 1), (1, 4, 4, 1, 10, 1),
    (101, 2, 10, 4, 0, 1), (2, 5, 10, 1, 30, 1), (2, 6, 10, 4, 0, 1), (2, 3, 10, 3, 0, 1), (3, 2, 4, 1, 20, 1), (3, 5, 99, 1, 20, 1),
]
MENU = [(2, 5, 77, 12, 0, 1), (2, 6, 77, 12, 0, 1)]


def tables(spark, with_menu=False):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    languages = frame([(5, "fr"), (9, "en"), (1, "ja")], "id int, identifier string")
    type_names = [(i, 5, fr) for i, _, fr, _ in TYPES] + [(i, 9, en) for i, _, _, en in TYPES]
    ids = {fr: i for i, _, fr, _ in TYPES}
    result = {
        "languages": languages,
        "pokemon_species": frame(
            [(i, n, g, leg, myth, parent, "45") for i, n, g, leg, myth, parent in SPECIES],
            "id int, identifier string, generation_id int, is_legendary string, is_mythical string,"
            " evolves_from_species_id int, capture_rate string"),
        "pokemon_species_names": frame([(i, 5, n) for i, n in NAMES_FR.items()], "pokemon_species_id int, local_language_id int, name string"),
        "pokemon": frame(ENTITIES, "id int, species_id int, identifier string, is_default int, height int, weight int"),
        "pokemon_forms": frame(FORMS, "id int, pokemon_id int, identifier string, form_identifier string, is_default int, is_mega int"),
        "custom_pokedex": frame(
            [(e, f, n, fr, en, t1, t2, e, label, en.lower(), {e: s for e, s, *_ in ENTITIES}[e], "1" if e < 100 else "0", "Première", None, None)
             for e, f, n, fr, en, t1, t2, label in ENTRIES],
            "pokemon_id int, pokemon_form_id int, national_number int, name_fr string, name_en string, type_1_fr string,"
            " type_2_fr string, source_row int, form_fr string, pokemon_identifier string, species_id int, is_default string,"
            " introduction_generation_fr string, signature_move_fr string, pseudo_signature_move_fr string"),
        "custom_pokedex_fr": frame(
            [(*row, {e: t1 for e, _, _, _, _, t1, _, _ in ENTRIES}[row[0]], {e: t2 for e, _, _, _, _, _, t2, _ in ENTRIES}[row[0]]) for row in SHEET],
            "source_row int, pv int, attaque int, defense int, attaque_speciale int, defense_speciale int, vitesse int, total_de_base int,"
            " sous_groupe string, stade_d_evolution string, talent_1 string, talent_2 string, talent_cache string,"
            " analyse_des_statistiques string, type_1 string, type_2 string"),
        "types": frame([(i, n) for i, n, _, _ in TYPES], "id int, identifier string"),
        "type_names": frame(type_names, "type_id int, local_language_id int, name string"),
        "type_efficacy": frame([(ids[a], ids[t], FACTORS.get((a, t), 100)) for a in ids for t in ids],
                               "damage_type_id int, target_type_id int, damage_factor int"),
        "version_groups": frame(GAMES + ([(77, "legends-arceus", 9, 4)] if with_menu else []), "id int, identifier string, generation_id int, order int"),
        "versions": frame([(1, 99, "red"), (2, 10, "sun"), (3, 50, "side")], "id int, version_group_id int, identifier string"),
        "pokemon_move_methods": frame(METHODS, "id int, identifier string"),
        "moves": frame([m[:7] for m in MOVES], "id int, identifier string, type_id int, damage_class_id int, power int, accuracy int, pp int"),
        "move_names": frame([(m[0], 5, m[7]) for m in MOVES] + [(m[0], 9, m[8]) for m in MOVES], "move_id int, local_language_id int, name string"),
        "pokemon_moves": frame(LEARN + (MENU if with_menu else []),
                               "pokemon_id int, move_id int, version_group_id int, pokemon_move_method_id int, level int, order int"),
        "items": frame([(1, "flame-stone"), (2, "berry")], "id int, identifier string"),
        "item_names": frame([(1, 5, "Pierre Feu"), (1, 9, "Flame Stone"), (2, 5, "Baie")], "item_id int, local_language_id int, name string"),
        "machines": frame([(6, 10, 12, 1)], "move_id int, version_group_id int, machine_number int, item_id int"),
        "evolution_triggers": frame([(1, "level-up"), (3, "use-item")], "id int, identifier string"),
        "pokemon_evolution": frame(
            [(1, 6, 1, None, None, 16, None, None, 0), (2, 6, 3, 4, None, None, None, 1, None), (3, 6, 1, 10, 101, None, None, None, None)],
            "id int, evolved_species_id int, evolution_trigger_id int, version_group_id int, required_pokemon_form_id int,"
            " minimum_level int, evolved_pokemon_form_id int, trigger_item_id int, relative_physical_stats int"),
        "ability_names": frame([(26, 5, "Lévitation"), (77, 9, "Only English")], "ability_id int, local_language_id int, name string"),
        "pokemon_abilities_past": frame([(1, 6, 26, 0, 1), (1, 4, 26, 1, 3), (2, 5, 77, 0, 2)],
                                        "pokemon_id int, generation_id int, ability_id int, is_hidden int, slot int"),
        "pokemon_stats_past": frame([(1, 5, 4, 80, 0), (1, 1, 9, 80, 0), (1, 3, 8, 100, 0)],
                                    "pokemon_id int, generation_id int, stat_id int, base_stat int, effort int"),
        "pokemon_items": frame([(1, 1, 2, 50), (1, 1, 1, 5), (1, 2, 1, 1), (1, 3, 1, 100)],
                               "pokemon_id int, version_id int, item_id int, rarity int"),
    }
    return result


def catalogue(spark, with_menu=False, **replaced):
    source = tables(spark, with_menu)
    source.update(replaced)
    folder = tempfile.mkdtemp(prefix="lorespark-fixture-")
    for name, df in source.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    source = {name: spark.read.parquet(f"{folder}/{name}") for name in source}
    return Catalogue.from_source(source)

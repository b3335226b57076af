"""Declared schemas (DDL) of the message table and of the token, frame and phase tables. Absent fields are read as typed nulls."""

from __future__ import annotations

LINKS = "array<struct<url:string,texte:string>>"
REACTIONS = "array<struct<emoji:string,count:bigint>>"

#: Names and types of the message fields, in the stages' order.
MESSAGE = (
    "message_id int, canal string, date string, album_id string, album_rang int, est_transfere boolean, legende string, "
    f"liens_externes {LINKS}, media_type string, media_chemin string, duree double, fps double, largeur int, hauteur int, "
    "video_bitrate int, fichier_taille bigint, orientation string, audio_present boolean, fichier_hash string, perceptual_hash string, "
    f"vues bigint, transferts bigint, reactions bigint, reactions_detail {REACTIONS}, dialogue string, parole_present boolean, "
    "parole_duree double, parole_ratio double, dialogue_confiance double, audio_parole_pure_ratio double, audio_musique_ratio double, "
    "audio_parole_sur_musique_ratio double, audio_silence_ratio double, audio_dominant string, audio_segmentation_modele string, "
    "legende_fr string, dialogue_fr string, ocr_texte string, ocr_filigrane_texte string, ocr_confiance double, "
    "ocr_filigrane_present boolean, scene_coupes int, scene_coupes_par_min double, scene_duree_moyenne double, visages_densite double, "
    "visages_unique int, blason_present boolean, blason_detecte string, blason_zone string"
)
TOKENS = ("message_id string, date string, period string, phase string, token string, lemma string, tag string, pos int")
FACES = (
    "message_id int, frame_filename string, frame_index int, frame_position double, face_index int, cluster_id int, is_target boolean, "
    "similarity double, det_score double, n_faces_in_frame int, date string, phase string"
)
PHASES = ("phase_id string, label string, start date, end date, color string")
EDGES = ("Source string, Target string, Weight double, RawCount bigint")
SEGMENTS = ("start double, end double, text string")
